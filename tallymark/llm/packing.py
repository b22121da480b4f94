"""Cost-balanced packing of documents into token sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``, the second part
for attention within the piece. Whole sequences are cut off long documents;
what is left is taken by falling cost, each time to the cheapest sequence with
room for it. A piece that fits nowhere is cut to fill what room there is, so
that less than one sequence is lost to padding in each chunk.

A chunk is what one task has read until ``CHUNK_TOKENS`` ids are together; no
rows are moved between tasks, and memory is bounded by a chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import small_batches, table, text_slices
from tallymark.llm.token_ids import encoder

SEQUENCE = 1024
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
CHUNK_TOKENS = 2_000_000
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


def assign(lengths: np.ndarray, size: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) for items of under ``size`` tokens each.

    The number of sequences is the least that can hold all tokens.
    """
    n_seq = -(-int(lengths.sum()) // size)
    cost, room = np.zeros(n_seq), np.full(n_seq, size, np.int64)
    out = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        at, left = 0, int(lengths[item])
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            s = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(left, int(room[s]))
            out.append((item, at, n, s, size - int(room[s])))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            at, left = at + n, left - n
    return out


def _pack_chunk(keys: list, ids: list[np.ndarray], first: int, size: int) -> tuple[dict[str, list], int]:
    rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}

    def piece(k: int, start: int, n: int, sequence: int, offset: int) -> None:
        x = ids[k]
        for name, v in zip(rows, (keys[k], start, n, zlib.crc32(x[start : start + n].data), len(x), sequence, offset), strict=True):
            rows[name].append(v)

    n = np.array([len(x) for x in ids], np.int64)
    sequence = first
    for k in np.flatnonzero(n >= size).tolist():
        for j in range(int(n[k]) // size):
            piece(k, j * size, size, sequence, 0)
            sequence += 1
    rest = n % size
    some = np.flatnonzero(rest)
    done = assign(rest[some], size)
    for item, at, length, s, offset in done:
        k = int(some[item])
        piece(k, int(n[k] - rest[k]) + at, length, sequence + s, offset)
    return rows, sequence + max((x[3] for x in done), default=-1) + 1


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: its document, place and length there, checksum, and its sequence and offset.

    Every document ends with ``end_id``, so a null or empty text has one id.
    Repeated rows are packed as often as they occur; a null doc_id is carried
    as it is. Texts of any length are cut into whole sequences and a rest. An
    empty table gives no rows. Sequence ids are unique over all tasks.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, True)
        sequence = TaskContext.get().partitionId() << 32
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0

        def out(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        schema = None
        for batch in text_slices(batches, "text"):
            schema = schema or pa.schema([("doc_id", batch.schema.field("doc_id").type)] + [(k, pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
            flat, n = enc.encode(batch.column("text").to_pylist())
            ends = np.cumsum(n)
            for key, stop, k in zip(batch.column("doc_id").to_pylist(), ends.tolist(), n.tolist(), strict=True):
                keys.append(key)
                ids.append(np.append(flat[stop - k : stop], np.uint32(end_id)).astype("<u4"))
                held += k + 1
            if held >= CHUNK_TOKENS:
                rows, sequence = _pack_chunk(keys, ids, sequence, size)
                yield out(rows, schema)
                keys, ids, held = [], [], 0
        if keys:
            rows, sequence = _pack_chunk(keys, ids, sequence, size)
            yield out(rows, schema)

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
