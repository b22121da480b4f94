"""Token ids as raw binary shards, each with a minimal perfect hash index over its documents.

A shard file, little-endian:

    magic            8 bytes   TALLYID1
    shard_no         uint64    part << 32 | place in the part; shards in this order hold rising keys
    n_docs, n_ids, n_keys, n_buckets   uint64 each
    width, seed      uint32 each       bytes of an id
    keys             int64  x n_docs
    null_keys        uint8  x n_docs
    offsets          uint64 x n_docs + 1    first id of every document
    displacements    uint32 x n_buckets
    fingerprints     uint32 x n_keys
    ordinals         uint32 x n_keys
    ids              uint16 or uint32 x n_ids
    end              1 byte    a line feed

A key's bucket names a displacement, and key and displacement give its slot: a
high bit in the displacement means that the rest of it is the slot. The slot
holds a fingerprint of the key, which tells absent keys, and the document's
ordinal. A directory beside the shards, sorted by first key, tells which shard
can hold a key. A lookup finds the shard in the directory and then reads a few
ranges of it, whatever the number of shards and their size.

Spark's text writer writes the files, one record each, so they may go to any
store that Spark writes to, under its commit protocol.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.llm.common import all_open, contents, listed, mix64, new_path, opened, removed_at_end, small_batches, stored, table, text_slices
from tallymark.llm.ranges import range_reader
from tallymark.llm.token_ids import encoder

MAGIC = b"TALLYID1"
HEADER = struct.Struct("<8sQQQQQII")
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SHARD_IDS = 2_000_000
SHARD_DOCS = 8192
KEYS_A_BUCKET = 2
_DIRECT = np.uint32(1 << 31)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashes(keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(for the bucket, for the slot, fingerprint) of keys."""
    with np.errstate(over="ignore"):
        k = keys.astype(np.int64).view(np.uint64)
        a = mix64(k + np.uint64(seed + 1) * _STEP)
        b = mix64(a ^ np.uint64(0xD6E8FEB86659FD93))
        c = mix64(b + k)
    return a, b, (c >> np.uint64(32)).astype(np.uint32)


def _slots(b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(b + d.astype(np.uint64) * _STEP) % np.uint64(n)


class PerfectHash:
    """Distinct int64 keys to the numbers 0 ... n-1, one to one, with fingerprints."""

    def __init__(self, n: int, seed: int, displacements: np.ndarray, fingerprints: np.ndarray, ordinals: np.ndarray):
        self.n, self.seed = n, seed
        self.displacements, self.fingerprints, self.ordinals = displacements, fingerprints, ordinals

    @classmethod
    def build(cls, keys: np.ndarray, ordinals: np.ndarray) -> PerfectHash:
        n = len(keys)
        for seed in range(1000):
            a, b, prints = _hashes(keys, seed)
            n_buckets = max(1, -(-n // KEYS_A_BUCKET))
            bucket = (a % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sizes = np.bincount(bucket, minlength=n_buckets)
            starts = np.cumsum(sizes) - sizes
            free = np.ones(n, bool)
            disp = np.zeros(n_buckets, np.uint32)
            slot_of = np.zeros(n, np.int64)
            if not cls._place(b, order, sizes, starts, free, disp, slot_of, n):
                continue
            out = cls(n, seed, disp, np.zeros(n, np.uint32), np.zeros(n, np.uint32))
            out.fingerprints[slot_of] = prints
            out.ordinals[slot_of] = ordinals
            return out
        raise ValueError("keys are not distinct")

    @staticmethod
    def _place(b, order, sizes, starts, free, disp, slot_of, n) -> bool:
        tries = np.arange(1 << 6, dtype=np.uint64)
        single = []
        for k in np.argsort(-sizes, kind="stable").tolist():
            if sizes[k] == 0:
                break
            own = order[starts[k] : starts[k] + sizes[k]]
            if len(own) == 1:
                single.append((k, int(own[0])))
                continue
            for base in range(0, 1 << 16, len(tries)):
                s = _slots(b[own][None, :], (tries + np.uint64(base))[:, None], n).astype(np.int64)
                t = np.sort(s, axis=1)
                good = np.flatnonzero(free[s].all(axis=1) & (t[:, 1:] != t[:, :-1]).all(axis=1))
                if len(good):
                    s = s[good[0]]
                    free[s] = False
                    slot_of[own] = s
                    disp[k] = base + int(good[0])
                    break
            else:
                return False
        for (k, key), slot in zip(single, np.flatnonzero(free).tolist(), strict=False):
            disp[k] = _DIRECT | np.uint32(slot)
            slot_of[key] = slot
        return True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ordinals of keys, -1 where the fingerprint tells that a key is absent."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        a, b, prints = _hashes(keys, self.seed)
        d = self.displacements[(a % np.uint64(len(self.displacements))).astype(np.int64)]
        slot = np.where(d & _DIRECT, d & ~_DIRECT, _slots(b, d, self.n)).astype(np.int64)
        return np.where(self.fingerprints[slot] == prints, self.ordinals[slot].astype(np.int64), -1)


def shard_bytes(shard_no: int, keys: list, ids: list[np.ndarray], width: int) -> bytes:
    """The file of a shard, without its last byte, which the writer adds."""
    null = np.array([k is None for k in keys], np.uint8)
    k = np.array([0 if x is None else x for x in keys], np.int64)
    known = np.flatnonzero(null == 0)
    distinct, first = np.unique(k[known], return_index=True)
    index = PerfectHash.build(distinct, known[first].astype(np.uint32))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    parts = [HEADER.pack(MAGIC, shard_no, len(keys), int(offsets[-1]), len(distinct), len(index.displacements), width, index.seed)]
    parts += [k.astype("<i8").tobytes(), null.tobytes(), offsets.tobytes()]
    parts += [x.astype("<u4").tobytes() for x in (index.displacements, index.fingerprints, index.ordinals)]
    parts += [x.astype(f"<u{width}").tobytes() for x in ids]
    return b"".join(parts)


class Shard:
    """A shard file that has been read, or mapped, into memory."""

    def __init__(self, content: bytes):
        magic, self.shard_no, n, n_ids, n_keys, n_buckets, width, seed = HEADER.unpack_from(content)
        if magic != MAGIC or content[-1:] != b"\n":
            raise ValueError("not a whole shard")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(content, kind, count, at)
            at += x.nbytes
            return x

        self.keys, self.null_keys, self.offsets = take("<i8", n), take("u1", n), take("<u8", n + 1).astype(np.int64)
        self.index = PerfectHash(n_keys, seed, take("<u4", n_buckets), take("<u4", n_keys), take("<u4", n_keys))
        self.ids = take(f"<u{width}", n_ids)

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the (first) document with this key, or None."""
        k = int(self.index.find(np.array([key], np.int64))[0])
        return None if k < 0 or self.keys[k] != key else self.ids[self.offsets[k] : self.offsets[k + 1]]


def _head(data: bytes) -> tuple[int, int, int, int, int, int, int]:
    """shard_no, n_docs, n_ids, n_keys, n_buckets, width, seed."""
    magic, *rest = HEADER.unpack(data)
    if magic != MAGIC:
        raise ValueError("not a shard")
    return tuple(rest)


class RemoteShard:
    """A shard file of which ``read(offset, length)`` fetches ranges."""

    def __init__(self, read):
        self.read = read
        self.shard_no, self.n, _, self.n_keys, self.n_buckets, self.width, self.seed = _head(bytes(read(0, HEADER.size)))
        sizes = [HEADER.size, 8 * self.n, self.n, 8 * (self.n + 1), 4 * self.n_buckets, 4 * self.n_keys, 4 * self.n_keys]
        self.keys, self.null_keys, self.offsets, self.displacements, self.fingerprints, self.ordinals, self.ids = np.cumsum(sizes).tolist()

    def _numbers(self, kind: str, start: int, at: int, n: int = 1) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(bytes(self.read(start + at * size, n * size)), kind)

    def key_range(self) -> tuple[int, int] | None:
        """The first and last key, or None if all keys are null; null keys stand first."""
        if not self.n_keys:
            return None
        n_null = int(np.frombuffer(bytes(self.read(self.null_keys, self.n)), np.uint8).sum())
        return int(self._numbers("<i8", self.keys, n_null)[0]), int(self._numbers("<i8", self.keys, self.n - 1)[0])

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the (first) document with this key, or None, by six ranges."""
        if not self.n_keys:
            return None
        a, b, prints = _hashes(np.array([key], np.int64), self.seed)
        d = self._numbers("<u4", self.displacements, int(a[0] % np.uint64(self.n_buckets)))
        slot = int(d[0] & ~_DIRECT) if d[0] & _DIRECT else int(_slots(b, d, self.n_keys)[0])
        if self._numbers("<u4", self.fingerprints, slot)[0] != prints[0]:
            return None
        k = int(self._numbers("<u4", self.ordinals, slot)[0])
        if self._numbers("<i8", self.keys, k)[0] != key:
            return None
        start, stop = self._numbers("<u8", self.offsets, k, 2).tolist()
        return self._numbers(f"<u{self.width}", self.ids, start, stop - start)


def write_ids(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Writes the ids of all texts to shard files under ``path``, by rising id.

    Null texts count as empty and have the end id alone. Rows with a null id
    come first; the index leaves them out, as it does all but the first row of
    an id that occurs more than once, but the shard lists them. Ties are
    ordered by a hash of the text. Ids are integers; text that is no integer
    raises. Texts are encoded whole, however long. An empty table writes no
    shard. Other columns are not read. Sets the session's Arrow batch size.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, False)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id) < 1 << 16 else 4
        no = TaskContext.get().partitionId() << 32
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in text_slices(batches, "text"):
            flat, n = enc.encode(batch.column("text").to_pylist())
            ends = np.cumsum(n)
            for key, stop, k in zip(batch.column("k").to_pylist(), ends.tolist(), n.tolist(), strict=True):
                if keys and (held + k + 1 > SHARD_IDS or len(keys) >= SHARD_DOCS):
                    yield pa.RecordBatch.from_pydict({"content": pa.array([shard_bytes(no, keys, ids, width)], pa.binary())})
                    no, keys, ids, held = no + 1, [], [], 0
                keys.append(key)
                ids.append(np.append(flat[stop - k : stop], np.uint32(end_id)).astype(f"<u{width}"))
                held += k + 1
        if keys:
            yield pa.RecordBatch.from_pydict({"content": pa.array([shard_bytes(no, keys, ids, width)], pa.binary())})

    given = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text"))
    dealt = given.withColumn("tie", F.xxhash64("text")).repartitionByRange("k", "tie").sortWithinPartitions("k", "tie").select("k", "text")
    files = dealt.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(path)
    write_directory(spark, path)


_DIRECTORY = "first long, last long, file string"


def write_directory(spark: SparkSession, path: str) -> None:
    """(first, last, file) of the shards under ``path`` to ``path`` + "-directory", sorted by first key over all its files."""

    def row(name: str, read) -> pa.RecordBatch:
        ends = RemoteShard(read).key_range()
        return pa.RecordBatch.from_pydict({"first": pa.array(ends[:1] if ends else [], pa.int64()), "last": pa.array(ends[1:] if ends else [], pa.int64()), "file": pa.array([name] if ends else [], pa.string())})

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with opened(name) as f:
                    yield row(name, lambda at, n: f.read_at(n, at))  # noqa: B023

    files = listed(spark, path)
    rows = files.select("path").mapInArrow(by_range, _DIRECTORY) if all_open(files) else _ranges_by_spark(spark, files)
    rows.repartitionByRange("first", "last").sortWithinPartitions("first", "last", "file").write.parquet(path + "-directory")


def _ranges_by_spark(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The rows of the directory where only Spark opens the store: of each shard its head, then its keys, which are one range with their null marks."""
    read = range_reader(spark)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [_head(x) for x in batch.column("head").to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "n": pa.array([h[1] for h in heads], pa.int64()), "n_keys": pa.array([h[3] for h in heads], pa.int64())})

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, n, data in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "data")), strict=True):
                keys, nulls = np.frombuffer(data, "<i8", n), int(np.frombuffer(data, np.uint8, n, 8 * n).sum())
                rows.append((int(keys[nulls]), int(keys[-1]), name))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["first", "last", "file"])

    heads = files.select("path", read(F.col("path"), F.lit(0).cast("long"), F.lit(HEADER.size).cast("long")).alias("head"))
    known = heads.mapInArrow(places, "path string, n long, n_keys long").where("n_keys > 0")
    return known.select("path", "n", read(F.col("path"), F.lit(HEADER.size).cast("long"), F.col("n") * 9).alias("data")).mapInArrow(ends, _DIRECTORY)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards under ``path``: doc_id, start, n_tokens, ids_crc32.

    Ids are fetched through each shard's index; the rows that it leaves out
    (null and repeated ids) are read by their place. Without shards there are
    no rows.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                s = Shard(content.as_buffer())
                n = len(s.keys)
                place = np.arange(n)
                found = s.index.find(s.keys)
                first = np.ones(n, bool)
                first[1:] = (s.keys[1:] != s.keys[:-1]) | (s.null_keys[1:] != s.null_keys[:-1])
                place = np.where(first & (s.null_keys == 0), found, place)
                if (place < 0).any() or (s.keys[place] != s.keys).any():
                    raise ValueError("the index of a shard doesn't hold its keys")
                start, stop = s.offsets[place], s.offsets[place + 1]
                wide = s.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].data) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(s.keys, pa.int64(), mask=s.null_keys.astype(bool)),
                    "part": pa.array(np.full(n, s.shard_no >> 32)), "no": pa.array(np.full(n, s.shard_no & 0xFFFFFFFF)),
                    "at": pa.array(start), "n_tokens": pa.array(stop - start), "ids_crc32": pa.array(crc, pa.int64()),
                })

    files = contents(spark, path).select("content")
    rows = stored(files.mapInArrow(run, "doc_id long, part long, no long, at long, n_tokens long, ids_crc32 long"), "ids-rows")
    shards = rows.groupBy("part", "no").agg(F.sum("n_tokens").alias("n"))
    # Parts are written partitions: a bounded number of rows, whatever the input.
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    shards = shards.withColumn("inner", F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    shards = shards.join(parts, "part").select("part", "no", (F.col("base") + F.col("inner")).alias("base"))
    out = rows.join(shards, ["part", "no"])
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> dict[int, np.ndarray | None]:
    """Ids of a few documents by key, None for absent ones.

    The directory's statistics lead to the shards that can hold a key, one
    unless an id's repeats go over several; of each shard only ranges are
    read, by a small Spark job each where Python can't open the store.
    """
    out: dict[int, np.ndarray | None] = dict.fromkeys(keys)
    if not out:
        return out
    can_hold = reduce(or_, [(F.col("first") <= k) & (F.col("last") >= k) for k in out])
    for r in spark.read.schema(_DIRECTORY).parquet(path + "-directory").where(can_hold).orderBy("first", "last", "file").collect():
        f = opened(r.file)
        shard = RemoteShard((lambda at, n: f.read_at(n, at)) if f else _reader(spark, r.file))  # noqa: B023
        for k in out:
            if out[k] is None and r.first <= k <= r.last:
                out[k] = shard.get(k)
        if f:
            f.close()
    return out


def _reader(spark: SparkSession, file: str):
    """``read(offset, length)`` of a file, each a job of one row."""
    read = range_reader(spark)
    return lambda at, n: spark.range(1).select(read(F.lit(file), F.lit(int(at)).cast("long"), F.lit(int(n)).cast("long"))).first()[0]


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    removed_at_end(spark, path, path + "-directory")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path)
