"""Document fingerprints by winnowing, and their comparison along the order of ids.

Every run of K code points is hashed by a rolling polynomial; of each window
of W such hashes the smallest is kept, the rightmost if several are equal, with
its position. Two texts that share K + W - 1 code points in a row share a kept
hash, and its positions say where. A fingerprint is a text: the kept hashes (8
bytes each, little-endian) and the gaps between their positions (a byte each),
in base64.

Documents are compared with the next one by falling id. Ids alone are sorted
first, to find where the tasks' ranges begin; each document then goes to the
task of its range, the first of a range also to the range before it, and every
task reads its documents in order and holds two at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import mix64, small_batches, table, text_slices

#: Code points of a gram, and grams of a window.
K = 16
WINDOW = 32
#: Windows that are worked on at a time, so that a long text takes bounded memory beyond itself.
BLOCK = 1 << 18
#: Text of the batches that come back from a worker.
OUT_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 14)
        for base in (_BASE, _INVERSE):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
        del _POWERS[:-2]
    return _POWERS[0][:n], _POWERS[1][:n]


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` codes; shorter input counts as filled up with zeros, which codes here never are."""
    n = max(len(codes), k)
    x = np.zeros(n + 1, np.uint64)
    x[1 : len(codes) + 1] = codes
    up, down = _powers(n + 1)
    np.multiply(x[1:], down[:n], out=x[1:])
    sums = np.add.accumulate(x)
    return mix64((sums[k:] - sums[:-k]) * up[: n - k + 1])


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest of every ``w`` hashes in a row, the rightmost of equals, each once."""
    w = min(w, len(h))
    at = np.arange(len(h))
    span = 1
    while span < w:
        step = min(span, w - span)
        right = h[step:] <= h[:-step]
        h, at = np.where(right, h[step:], h[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def winnow(text: str | None, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that stay. A text of fewer than ``k`` code points is one gram; null and empty ones have none."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    windows = max(1, len(codes) - k + 1 - w + 1)
    parts = []
    for a in range(0, windows, BLOCK):
        h = grams(codes[a : min(a + BLOCK, windows) + k + w - 2], k)
        at = _window_minima(h, w)
        parts.append((h[at], at + a))
    hashes, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.concatenate([[True], at[1:] != at[:-1]])
    return hashes[new], at[new]


def encoded(hashes: np.ndarray, positions: np.ndarray) -> str:
    gaps = np.diff(positions, prepend=-1) - 1
    return base64.b64encode(hashes.astype("<u8").tobytes() + gaps.astype(np.uint8).tobytes()).decode()


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    n = len(raw) // 9
    return np.frombuffer(raw, "<u8", n).astype(np.uint64), np.cumsum(np.frombuffer(raw, np.uint8, n, 8 * n).astype(np.int64) + 1) - 1


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _once(fingerprint: str) -> dict[int, int]:
    """Positions of the hashes that a fingerprint holds once."""
    hashes, at = decoded(fingerprint)
    own, first, n = np.unique(hashes, return_index=True, return_counts=True)
    return dict(zip(own[n == 1].tolist(), at[first[n == 1]].tolist(), strict=True))


def matches(a: str, b: str, k: int = K) -> list[tuple[int, int, int]]:
    """(position in a, position in b, length) of common passages: kept grams at one distance that overlap or touch.

    Grams that one of the texts repeats anchor no passage.
    """
    of_a, of_b = _once(a), _once(b)
    out: list[list[int]] = []
    for shift, p in sorted((of_b[h] - p, p) for h, p in of_a.items() if h in of_b):
        if out and out[-1][1] - out[-1][0] == shift and p <= out[-1][0] + out[-1][2]:
            out[-1][2] = p + k - out[-1][0]
        else:
            out.append([p, p + shift, k])
    return [tuple(x) for x in out]


def _check(k: int, w: int) -> None:
    if k < 1 or not 1 <= w <= 255:
        raise ValueError("k must be at least 1, and w from 1 to 255, so that gaps fit a byte")


def fingerprints(docs: DataFrame, *, k: int = K, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint, n_hashes) of every row; a null or empty text has an empty fingerprint.

    Repeated rows and null ids are rows like any other, and an empty table
    gives none. Other columns aren't read. Sets the session's Arrow batch size.
    """
    _check(k, w)
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", OUT_BYTES):
            texts = batch.column("text").to_pylist()
            got = [winnow(t, k, w) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([encoded(*x) for x in got], pa.string()), pa.array([len(h) for h, _ in got], pa.int64())], ["doc_id", "n_chars", "fingerprint", "n_hashes"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string, n_hashes long")


def _range(key: Column, starts: list) -> Column:
    """The last of the falling ``starts`` that is at the key or above it: looked up among every 64th, then among the 64 from there."""
    steps = [starts[a : a + 64] for a in range(0, len(starts), 64)]
    above = lambda xs: F.size(F.filter(xs, lambda b: b >= key)) - 1
    row = lambda xs: F.array(*map(F.lit, xs))
    step = F.greatest(above(row([x[0] for x in steps])), F.lit(0))
    return step * 64 + above(F.get(F.array(*map(row, steps)), step))


def dealt(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) by falling id, null ids last and those of one id by a hash of the text; a partition for each range of ids.

    Behind the rows of a range come those of the id that the next range begins
    with, marked as ``guest``; the last range is followed by the first. There
    are as many ranges as ``spark.sql.shuffle.partitions`` says.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(n, F.desc("doc_id"))
    # One id for each task: where its range begins.
    starts = sorted((r.m for r in ids.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("m")).collect()), reverse=True)
    n = max(1, len(starts))
    place, first = (F.coalesce(_range(F.col("doc_id"), starts), F.lit(n - 1)), F.coalesce(F.col("doc_id").isin(starts), F.lit(False))) if starts else (F.lit(0), F.lit(True))
    sent = lambda to, guest: F.array(F.struct(to.cast("int").alias("to"), F.lit(guest).alias("guest")))
    own, before = sent(F.col("place"), False), sent(F.pmod(F.col("place") - 1, F.lit(n)), True)
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), place.alias("place"), first.alias("first"))
    d = d.select("doc_id", "text", "h", F.explode(F.when(F.col("first"), F.concat(own, before)).otherwise(own)).alias("sent"))
    return d.select("doc_id", "text", "h", "sent.to", "sent.guest").repartitionById(n, "to").sortWithinPartitions("guest", F.desc("doc_id"), "h")


def edited(text: str, following: str) -> str:
    """The last half of a text, rounded down, replaced by the first as many code points of the following one, or by all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, *, k: int = K, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike it is to that and to the next document's.

    The next document is that of the next smaller id, after the last one the
    first; null ids come last. Documents of one id follow each other by a hash
    of their texts, one after the other in one task, as do those without an
    id. A null text counts as empty; an empty fingerprint is like another empty
    one (1) and unlike any other (0). Texts are read whole, in blocks beyond
    some 262,144 code points. A single document follows itself, and an empty
    table gives no rows. Other columns aren't read. Sets the session's Arrow
    batch size.
    """
    _check(k, w)
    small_batches(docs.sparkSession)
    d = dealt(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    kind = d.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def row(own: tuple, following: tuple) -> tuple:
        doc_id, text, hashes, at = own
        new = edited(text, following[1])
        new_hashes, new_at = winnow(new, k, w)
        return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encoded(hashes, at), encoded(new_hashes, new_at), likeness(hashes, new_hashes), likeness(hashes, following[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first = None
        kinds = None
        done = False
        for batch in text_slices(batches, "text", OUT_BYTES):
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            out = []
            for doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest")), strict=True):
                if done:
                    break
                here = (doc_id, text, *winnow(text, k, w))
                first = first or here
                if held:
                    out.append(row(held, here))
                held, done = (None, True) if guest else (here, False)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(held, first), kinds, strict=True)], names)

    return d.select("doc_id", "text", "guest").mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
