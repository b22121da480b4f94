"""Scores of texts by a Brown class bigram model: P(class | class before) * P(word | class).

Texts are turned to codes once and kept in the shared folder, each batch of
texts with its own word list, sorted by hash. Buckets are ranges of hashes, so
that whatever a bucket answers about a batch's words falls into place by
itself. Words are never joined row by row, and no vocabulary is broadcast or
collected; a bucket is read as a stream and holds its distinct words alone.

Classes come in two steps. Exchange clustering on the driver moves the
``HEAD_WORDS`` most frequent words, and 256 forms (ending and length) that
stand for all others, between classes by their bigrams. Then every other word
seen ``MIN_COUNT`` times or more, however many there are, takes the class that
its own neighbours' classes favour: one step of the exchange against the fixed
class matrix, made in the word's bucket. Rarer and unseen words keep the class
of their form. The transitions are counted anew over the final classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import crc_mod, dropped, small_batches, stored, table, text_slices

#: Words that the driver clusters; all others are assigned in their buckets.
HEAD_WORDS = 768
MIN_COUNT = 5
FORMS = 256
CLASSES = 64
SWEEPS = 8
TRANSITION_PRIOR = 0.1
WORD_PRIOR = 0.5
BATCH_TEXT = 8 << 20
#: Words of all batches that come to one bucket, on average.
BUCKET_WORDS = 2_000_000
LEAST_BUCKETS = 64
#: Tasks of a stage that has one for each batch of texts, while they are few.
MOST_TASKS = 100_000
#: Words that a bucket gathers before it adds them up.
HELD_WORDS = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
END = xxhash.xxh3_64_intdigest(b"")
#: In place of a class: the word has that of its form.
BY_FORM = 255


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; null counts as empty."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def form(word: bytes) -> int:
    """Ending and length of a word, as one of 256."""
    return (zlib.crc32(word[-3:]) % 64) * 4 + min(3, len(word) // 5)


def _planes(codes: np.ndarray) -> bytes:
    """Low bytes, then middle bytes, then high bytes: files keep these small."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int32)
    return x[0] | x[1] << 8 | x[2] << 16


def _u64(x) -> np.ndarray:
    return np.frombuffer(x, "<u8")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def tokenised(docs: DataFrame) -> DataFrame:
    """A row for each batch of texts: ids and flags of its rows, token codes, and its words by rising hash, with forms and learning counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 32
        for batch in text_slices(batches, "text", BATCH_TEXT, 8192):
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            known: dict[bytes, int] = {b"": 0}
            parts, sizes = [], []
            for text in batch.column("text").to_pylist():
                got = [known.setdefault(w, len(known)) for w in words(text)]
                got.append(0)
                parts.append(np.array(got, np.int32))
                sizes.append(len(got))
            codes = np.concatenate(parts)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            forms = np.fromiter(map(form, known), np.uint8, len(known))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            codes = place[codes]
            learn = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(known))
            yield pa.RecordBatch.from_arrays([
                pa.array([no]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(batch.schema.field("doc_id").type)), pa.array([held.tolist()], pa.list_(pa.bool_())),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([_planes(codes)], pa.binary()), pa.array([hashes[order].tobytes()], pa.binary()), pa.array([forms[order].tobytes()], pa.binary()), pa.array([learn.astype("<u4").tobytes()], pa.binary()), pa.array([len(known)]),
            ], ["batch", "doc_ids", "held", "sizes", "codes", "hashes", "forms", "learn", "n"])
            no += 1

    given = docs.select("doc_id", "held", "text")
    return stored(given.mapInArrow(run, f"batch long, doc_ids array<{kind}>, held array<boolean>, sizes array<long>, codes binary, hashes binary, forms binary, learn binary, n long"), "lm-tokens")


#: What goes to a bucket: its own words first (kind 0), then pieces of batches (kind 1), each column by word but ``near``.
_PIECES = "bucket long, kind int, batch long, hashes binary, counts binary, marks binary, near binary"
_PIECE_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("marks", pa.binary()), ("near", pa.binary())])


def _cuts(hashes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first word, word after) of the ranges of sorted hashes that hold any."""
    own = (hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
    at = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]) if len(own) else np.zeros(1, np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(own[a]), a, b


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 7, _PIECE_SCHEMA, strict=True)], schema=_PIECE_SCHEMA)


def _streams(df: DataFrame, n_buckets: int) -> DataFrame:
    return df.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind")


class _Sums:
    """Distinct words of a bucket by rising hash, with their form and total."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.held = 0
        self.hashes, self.forms, self.totals = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray, forms: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((hashes, forms, counts.astype(np.int64)))
        self.held += len(hashes)
        if self.held > max(HELD_WORDS, len(self.hashes)):
            self.merge()

    def merge(self) -> None:
        h, f, c = (np.concatenate(x) for x in zip((self.hashes, self.forms, self.totals), *self.parts, strict=True))
        self.hashes, first, place = np.unique(h, return_index=True, return_inverse=True)
        self.forms = f[first]
        self.totals = np.zeros(len(self.hashes), np.int64)
        np.add.at(self.totals, place, c)
        self.parts, self.held = [], 0


def counted(tokens: DataFrame, n_buckets: int, head_words: int, min_count: int) -> DataFrame:
    """A row for each bucket with learning words: hashes, totals, sums, and its most frequent words of ``min_count`` or more."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            h, f, c = _u64(r["hashes"]), np.frombuffer(r["forms"], np.uint8), np.frombuffer(r["learn"], "<u4")
            seen = c > 0
            h, f, c = h[seen], f[seen], c[seen]
            yield _pieces([(k, 1, r["batch"], h[a:b].tobytes(), c[a:b].tobytes(), f[a:b].tobytes(), None) for k, a, b in _cuts(h, n_buckets)])

    def out(bucket: int, s: _Sums) -> pa.RecordBatch:
        s.merge()
        top = np.flatnonzero((s.totals >= min_count) & (s.hashes != np.uint64(END)))
        top = top[np.lexsort((s.hashes[top], -s.totals[top]))[:head_words]]
        rare = np.bincount(s.forms[(s.totals < min_count) & (s.hashes != np.uint64(END))], minlength=FORMS)
        values = [bucket, s.hashes.astype("<u8").tobytes(), s.totals.astype("<u8").tobytes(), int(s.totals.sum()), len(s.hashes), rare.tolist(), s.hashes[top].view(np.int64).tolist(), s.totals[top].tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sums = None, _Sums()
        for r in _rows(batches):
            if r["bucket"] != bucket:
                if bucket is not None:
                    yield out(bucket, sums)
                bucket, sums = r["bucket"], _Sums()
            sums.add(_u64(r["hashes"]), np.frombuffer(r["marks"], np.uint8), np.frombuffer(r["counts"], "<u4"))
        if bucket is not None:
            yield out(bucket, sums)

    longs = pa.list_(pa.int64())
    schema = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("totals", pa.binary()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("rare", longs), ("top", longs), ("top_n", longs)])
    dealt = tokens.select("batch", "hashes", "forms", "learn").mapInArrow(split, _PIECES)
    return stored(_streams(dealt, n_buckets).mapInArrow(merge, "bucket long, hashes binary, totals binary, n_tokens long, n_words long, rare array<long>, top array<long>, top_n array<long>"), "lm-counts")


class Head:
    """Units of words: a head word or the end mark has its own, any other that of its form."""

    def __init__(self, hashes: np.ndarray):
        """``hashes``: the head words by falling frequency."""
        self.end = FORMS + len(hashes)
        units = np.append(FORMS + np.arange(len(hashes)), self.end)
        hashes = np.append(hashes, np.uint64(END)).astype(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.units = hashes[order], units[order]

    def own(self, hashes: np.ndarray) -> np.ndarray:
        """Whether words have a unit of their own."""
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def of(self, hashes: np.ndarray, forms: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.units[at], forms)


def unit_bigrams(tokens: DataFrame, head: Head) -> np.ndarray:
    """Counts [before, unit] over all learning texts; each text follows an end mark."""
    units = head.end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(units * units, np.int64)
        for r in _rows(batches):
            u = head.of(_u64(r["hashes"]), np.frombuffer(r["forms"], np.uint8))[_from_planes(r["codes"])]
            before = np.concatenate([[head.end], u[:-1]])
            keep = np.repeat(~np.array(r["held"], bool), r["sizes"])
            sums += np.bincount((before * units + u)[keep], minlength=units * units)
        some = np.flatnonzero(sums)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["pair", "n"])

    rows = tokens.select("codes", "hashes", "forms", "sizes", "held").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(units * units)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(units, units)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(bigrams: np.ndarray, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of units: each unit in turn moves to the class that raises the bigram likelihood most, until none moves.

    The last unit, the end mark, keeps a class of its own. Units start dealt
    out by falling frequency; unseen units stay where they start.
    """
    n = len(bigrams)
    freq = bigrams.sum(0) + bigrams.sum(1)
    cls = np.zeros(n, np.int64)
    ranked = np.argsort(-freq[:-1], kind="stable")
    cls[ranked] = 1 + np.arange(n - 1) % (n_classes - 1)
    hot = np.zeros((n, n_classes))
    hot[np.arange(n), cls] = 1
    after = bigrams @ hot  # [unit, class that follows]
    before = (hot.T @ bigrams).T  # [unit, class before]
    counts = hot.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in ranked.tolist():
            if not freq[w]:
                continue
            old, own = cls[w], bigrams[w, w]
            r, c = after[w].copy(), before[w].copy()
            r[old] -= own
            c[old] -= own
            counts[old] -= r
            counts[:, old] -= c
            counts[old, old] -= own
            rows, cols = counts.sum(1), counts.sum(0)
            gain = (_xlogx(counts + r[None, :]) - _xlogx(counts)).sum(1) + (_xlogx(counts + c[:, None]) - _xlogx(counts)).sum(0)
            d = counts.diagonal()
            gain += _xlogx(d + r + c + own) - _xlogx(d + r) - _xlogx(d + c) + _xlogx(d)
            tr, tc = r.sum() + own, c.sum() + own
            gain -= _xlogx(rows + tr) - _xlogx(rows) + _xlogx(cols + tc) - _xlogx(cols)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            counts[new] += r
            counts[:, new] += c
            counts[new, new] += own
            if new != old:
                moved += 1
                cls[w] = new
                after[:, old] -= bigrams[:, w]
                after[:, new] += bigrams[:, w]
                before[:, old] -= bigrams[w]
                before[:, new] += bigrams[w]
        if not moved:
            break
    return cls


def favoured(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The class that each word's neighbours favour: the gain of the exchange, to first order, of words that are small in their class.

    ``left`` and ``right`` count the classes beside each word, ``counts`` the
    class bigrams. Class 0, the end mark's, takes no words.
    """
    n = len(counts)
    log = np.log(counts + TRANSITION_PRIOR)
    rows, cols = np.log(counts.sum(1) + TRANSITION_PRIOR * n), np.log(counts.sum(0) + TRANSITION_PRIOR * n)
    gain = right @ log.T + left @ log - right.sum(1, keepdims=True) * rows - left.sum(1, keepdims=True) * cols
    gain[:, 0] = -np.inf
    return gain.argmax(1)


def assigned(tokens: DataFrame, counts: DataFrame, n_buckets: int, head: Head, cls: np.ndarray, bigrams: np.ndarray, min_count: int) -> DataFrame:
    """A row for each bucket: hashes, totals and classes of its learning words, and how many words each class took.

    Words of the head have the class that exchange gave them, words of fewer
    than ``min_count`` tokens ``BY_FORM``, all others that of their neighbours.
    """
    hot = np.zeros((len(cls), CLASSES))
    hot[np.arange(len(cls)), cls] = 1
    matrix = hot.T @ bigrams @ hot
    end = int(cls[head.end])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            h, f, c = _u64(r["hashes"]), np.frombuffer(r["forms"], np.uint8), np.frombuffer(r["learn"], "<u4")
            codes = _from_planes(r["codes"])
            beside = cls[head.of(h, f)].astype(np.uint8)[codes]
            near = np.stack([np.concatenate([[end], beside[:-1]]), np.concatenate([beside[1:], [end]])], 1).astype(np.uint8)
            other = (c > 0) & ~head.own(h)
            at = np.flatnonzero(other[codes] & np.repeat(~np.array(r["held"], bool), r["sizes"]))
            near = near[at[np.argsort(codes[at], kind="stable")]]
            h, c = h[other], c[other]
            ends = np.concatenate([[0], np.cumsum(c, dtype=np.int64)])
            yield _pieces([(k, 1, r["batch"], h[a:b].tobytes(), c[a:b].tobytes(), None, near[ends[a] : ends[b]].tobytes()) for k, a, b in _cuts(h, n_buckets)])

    def out(bucket: int, h: np.ndarray, totals: np.ndarray, some: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        own = np.full(len(h), BY_FORM, np.uint8)
        is_head = head.own(h)
        own[is_head] = cls[head.of(h[is_head], np.zeros(int(is_head.sum()), np.uint8))]
        if len(some):
            own[some] = favoured(sums[:, :CLASSES], sums[:, CLASSES:], matrix)
        took = np.bincount(own[own != BY_FORM], minlength=CLASSES)
        values = [bucket, h.astype("<u8").tobytes(), totals.astype("<u8").tobytes(), own.tobytes(), took.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for r in _rows(batches):
            if r["kind"] == 0:
                if state:
                    yield out(*state)
                h, totals = _u64(r["hashes"]), _u64(r["counts"]).astype(np.int64)
                some = np.flatnonzero((totals >= min_count) & ~head.own(h))
                state = (r["bucket"], h, totals, some, np.zeros((len(some), 2 * CLASSES)))
                continue
            _, h, _, some, sums = state
            if not len(some):
                continue
            own, c = _u64(r["hashes"]), np.frombuffer(r["counts"], "<u4")
            near = np.frombuffer(r["near"], np.uint8).reshape(-1, 2).astype(np.int64)
            at = np.minimum(np.searchsorted(h[some], own), len(some) - 1)
            known = np.repeat(h[some][at] == own, c)
            row = np.repeat(at, c)[known] * (2 * CLASSES)
            flat = sums.reshape(-1)
            np.add.at(flat, row + near[known, 0], 1)
            np.add.at(flat, row + CLASSES + near[known, 1], 1)
        if state:
            yield out(*state)

    schema = pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("totals", pa.binary()), ("classes", pa.binary()), ("took", pa.list_(pa.int64()))])
    first = counts.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("batch"), "hashes", F.col("totals").alias("counts"), F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("binary").alias("near"))
    dealt = tokens.select("batch", "codes", "hashes", "forms", "learn", "sizes", "held").mapInArrow(split, _PIECES)
    return stored(_streams(first.unionByName(dealt), n_buckets).mapInArrow(merge, "bucket long, hashes binary, totals binary, classes binary, took array<long>"), "lm-words")


def answered(tokens: DataFrame, known: DataFrame, n_buckets: int, form_class: np.ndarray) -> DataFrame:
    """(batch, bucket, totals, classes) of the words of each batch, in their order within the bucket."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            h, f = _u64(r["hashes"]), np.frombuffer(r["forms"], np.uint8)
            yield _pieces([(k, 1, r["batch"], h[a:b].tobytes(), None, f[a:b].tobytes(), None) for k, a, b in _cuts(h, n_buckets)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        for r in _rows(batches):
            if r["bucket"] != bucket:
                bucket = r["bucket"]
                h, totals, classes = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.full(1, BY_FORM, np.uint8)
            if r["kind"] == 0:
                h, totals, classes = _u64(r["hashes"]), _u64(r["counts"]), np.frombuffer(r["marks"], np.uint8)
                continue
            own, f = _u64(r["hashes"]), np.frombuffer(r["marks"], np.uint8)
            at = np.minimum(np.searchsorted(h, own), len(h) - 1)
            found = h[at] == own
            c = np.where(found, classes[at], BY_FORM)
            c = np.where(c == BY_FORM, form_class[f], c).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r["batch"]]), pa.array([bucket]), pa.array([np.where(found, totals[at], 0).astype("<u8").tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["batch", "bucket", "totals", "classes"])

    first = known.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("batch"), "hashes", F.col("totals").alias("counts"), F.col("classes").alias("marks"), F.lit(None).cast("binary").alias("near"))
    dealt = tokens.select("batch", "hashes", "forms").mapInArrow(split, _PIECES)
    return _streams(first.unionByName(dealt), n_buckets).mapInArrow(answer, "batch long, bucket long, totals binary, classes binary")


def classed(tokens: DataFrame, answers: DataFrame, n_batches: int, total: int, vocabulary: int) -> DataFrame:
    """A row for each batch: ids, flags and sizes of its texts, the class of each token, and each text's sums that need no classes."""
    scale = float(np.log10(total + 1 * (vocabulary + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, totals, classes = None, [], []
        for r in _rows(batches):
            if r["bucket"] is not None:
                if r["batch"] != batch:
                    batch, totals, classes = r["batch"], [], []
                totals.append(r["totals"])
                classes.append(r["classes"])
                continue
            count, cls = _u64(b"".join(totals)).astype(np.int64), np.frombuffer(b"".join(classes), np.uint8)
            codes = _from_planes(r["codes"])
            sizes = np.array(r["sizes"], np.int64)
            at = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x[codes], at).tolist() for x in ((count > 0).astype(np.int64), np.log10(count + 1) - scale, np.log10(count + WORD_PRIOR))]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["doc_ids"]], pa.list_(doc_type)), pa.array([r["held"]], pa.list_(pa.bool_())), pa.array([r["sizes"]], pa.list_(pa.int64())), pa.array([cls[codes].tobytes()], pa.binary()),
                pa.array([sums[0]], pa.list_(pa.int64())), pa.array([sums[1]], pa.list_(pa.float64())), pa.array([sums[2]], pa.list_(pa.float64())),
            ], ["doc_ids", "held", "sizes", "classes", "known", "base", "words"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = tokens.schema["doc_ids"].dataType.elementType
    doc_type = to_arrow_type(kind)
    null = lambda t: F.lit(None).cast(t)
    own = ("doc_ids", "held", "sizes", "codes")
    left = answers.select("batch", "bucket", "totals", "classes", *(null(tokens.schema[c].dataType).alias(c) for c in own))
    right = tokens.select("batch", null("long").alias("bucket"), null("binary").alias("totals"), null("binary").alias("classes"), *own)
    # A batch's answers come before it, by rising bucket.
    both = left.unionByName(right).repartition(min(max(1, n_batches), MOST_TASKS), "batch").sortWithinPartitions("batch", F.col("bucket").asc_nulls_last())
    return stored(both.mapInArrow(run, f"doc_ids array<{kind.simpleString()}>, held array<boolean>, sizes array<long>, classes binary, known array<long>, base array<double>, words array<double>"), "lm-classes")


def class_bigrams(texts: DataFrame, end: int) -> np.ndarray:
    """Counts [before, class] over all learning texts; each text follows an end mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES * CLASSES, np.int64)
        for r in _rows(batches):
            c = np.frombuffer(r["classes"], np.uint8).astype(np.int64)
            keep = np.repeat(~np.array(r["held"], bool), r["sizes"])
            sums += np.bincount((np.concatenate([[end], c[:-1]]) * CLASSES + c)[keep], minlength=CLASSES * CLASSES)
        some = np.flatnonzero(sums)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["pair", "n"])

    rows = texts.select("held", "sizes", "classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES)


class ClassModel:
    """log10 tables: transitions between classes, and what a class's words share among them.

    A class keeps one place for all words that it has not seen.
    """

    def __init__(self, pairs: np.ndarray, distinct: np.ndarray):
        n = len(pairs)
        self.transition = np.log10((pairs + TRANSITION_PRIOR) / (pairs.sum(1, keepdims=True) + TRANSITION_PRIOR * n))
        self.total = np.log10(pairs.sum(0) + WORD_PRIOR * (distinct + 1))

    def tokens(self, before: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """What tokens score but for log10(count + WORD_PRIOR) of their words."""
        return self.transition[before, cls] - self.total[cls]


def score(docs: DataFrame, held, head_words: int = HEAD_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Learns from rows where ``held(doc_id)`` is false. ``head_words`` are
    clustered by exchange on the driver, which holds their bigrams as a square
    table; words of ``min_count`` tokens or more then get a class of their own. Null and empty texts are
    the end mark alone; very long texts are one row like any other. Repeated
    rows count and are scored as often as they occur; a null id counts as held
    out. Without learning rows all counts are zero and the priors decide. An
    empty table gives no rows. Other columns are not read. Sets the session's
    Arrow batch size.
    """
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(True)).alias("held"), F.col("text").cast("string").alias("text"))
    tokens = tokenised(given)
    n_words, n_batches = tokens.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_buckets = max(LEAST_BUCKETS, -(-(n_words or 0) // BUCKET_WORDS))
    counts = counted(tokens, n_buckets, head_words, min_count)
    total, vocabulary = (int(x or 0) for x in counts.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    rare = np.zeros(FORMS, np.int64)
    by_form = counts.select(F.posexplode("rare")).groupBy("pos").agg(F.sum("col").alias("n")).toArrow()
    rare[by_form.column("pos").to_numpy()] = by_form.column("n").to_numpy()
    top = counts.select(F.inline(F.arrays_zip("top", "top_n"))).orderBy(F.desc("top_n"), "top").limit(head_words).toArrow()
    head = Head(top.column("top").to_numpy().view(np.uint64))
    bigrams = unit_bigrams(tokens, head)
    cls = exchange(bigrams)
    known = assigned(tokens, counts, n_buckets, head, cls, bigrams, min_count)
    dropped(counts)
    distinct = np.bincount(cls[:FORMS], rare, CLASSES)
    for r in known.select(F.posexplode("took")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        distinct[r.pos] += r.n
    texts = classed(tokens, answered(tokens, known, n_buckets, cls[:FORMS]), n_batches, total, vocabulary)
    dropped(tokens, known)
    end = int(cls[head.end])
    model = ClassModel(class_bigrams(texts, end), distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1)
                get = lambda c: r.column(c).flatten()  # noqa: B023, E731
                c = np.frombuffer(r.column("classes")[0].as_buffer(), np.uint8).astype(np.int64)
                sizes = get("sizes").to_numpy()
                values = model.tokens(np.concatenate([[end], c[:-1]]), c)
                sums = np.add.reduceat(values, np.cumsum(sizes) - sizes) + get("words").to_numpy()
                yield pa.RecordBatch.from_arrays([get("doc_ids"), get("held"), pa.array(sizes), get("known"), pa.array(np.full(len(sizes), total)), get("base"), pa.array(sums)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_class_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), lambda k: crc_mod(k, 7) == 2)
