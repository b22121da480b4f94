"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a shallow tree on one
feature's bins and adds it, shrunk, to that feature's lookup table. Pairs with
the largest remaining gain then get tables of two features in the same way. A
score is the sum of looked-up bins, for whole batches at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import crc_mod, small_batches, table, text_slices

#: The model is fitted on at most so many labelled rows, those with the smallest hashes of their ids.
MAX_ROWS = 20_000
BINS = 32
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.1
L2 = 1.0

FEATURES = (
    "log_words", "word_chars", "word_chars_sd", "upper", "digit", "space", "sentence_end", "comma", "quote", "pipe",
    "symbol", "other_ascii", "high", "control", "distinct", "same_as_before", "repeated_pair", "top_word", "short_word", "long_word",
    "log_lines", "line_words", "repeated_line", "capital_word", "byte_entropy", "symbol_tail",
)

_KINDS = 13
_KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".?!", b",;:", b"\"'`()[]", b"|", b"#*$%&<>@^~_=+\\{}/")):
    _KIND[list(_bytes)] = _k
_KIND[list(set(range(33, 127)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.?!,;:\"'`()[]|#*$%&<>@^~_=+\\{}/"))] = 10
_KIND[128:] = 11
_KIND[[*range(9), *range(14, 32), 127]] = 12
_TAIL = frozenset(b"#*$%&|<>!@^~=+")


def features(text: str | None) -> list[float]:
    """The numbers that the model sees of a text; null counts as empty."""
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(b, np.uint8)
    each = np.bincount(raw, minlength=256)
    kind = np.bincount(_KIND, weights=each, minlength=_KINDS)
    size = max(1, len(b) - int(kind[3]) - int(kind[4]))
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    p = each[each > 0] / len(b)
    letters = max(1.0, kind[0] + kind[1])
    return [
        np.log1p(n), lengths.mean(), lengths.std(), kind[1] / letters, kind[2] / size, (kind[3] + kind[4]) / len(b), kind[5] / n, kind[6] / n, kind[7] / n, kind[8] / n,
        kind[9] / n, kind[10] / n, kind[11] / size, kind[12] / size, len(counts) / n, sum(map(eq, words, words[1:])) / n, 1 - pairs / max(1, n - 1), max(counts.values()) / n, (lengths <= 3).mean(), (lengths >= 12).mean(),
        np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), sum(65 <= w[0] <= 90 for w in words) / n, float(-(p * np.log2(p)).sum()), sum(w[-1] in _TAIL for w in words) / n,
    ]


def _best_cuts(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree with up to three leaves."""
    def gain(a, b):
        return a * a / (b + L2)

    def cut(lo: int, hi: int):
        if hi - lo < 2:
            return -np.inf, lo
        cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        tg, th = g[lo:hi].sum(), h[lo:hi].sum()
        x = gain(cg, ch) + gain(tg - cg, th - ch) - gain(tg, th)
        k = int(np.argmax(x))
        return float(x[k]), lo + k + 1

    edges = [0, len(g)]
    for _ in range(2):
        best = max((cut(a, b) for a, b in zip(edges, edges[1:], strict=False)), key=lambda x: x[0])
        if best[0] <= 0:
            break
        edges = sorted({*edges, best[1]})
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + L2)
    return out


def _best_quarters(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values on a grid: one cut along an axis, then one cut of each half along the other; the better of both orders."""
    def one(g, h):
        rg, rh = np.cumsum(g.sum(1))[:-1], np.cumsum(h.sum(1))[:-1]
        if not len(rg):
            return -np.inf, np.zeros_like(g)
        k = int(np.argmax(rg * rg / (rh + L2) + (g.sum() - rg) ** 2 / (h.sum() - rh + L2))) + 1
        out, total = np.zeros_like(g), 0.0
        for rows in (slice(0, k), slice(k, None)):
            cg, ch = np.cumsum(g[rows].sum(0)), np.cumsum(h[rows].sum(0))
            x = cg[:-1] ** 2 / (ch[:-1] + L2) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + L2)
            j = int(np.argmax(x)) + 1 if len(x) else g.shape[1]
            for cols in (slice(0, j), slice(j, None)):
                a, b = g[rows, cols].sum(), h[rows, cols].sum()
                out[rows, cols] = a / (b + L2)
                total += a * a / (b + L2)
        return total, out

    a, b = one(g, h), one(g.T, h.T)
    return a[1] if a[0] >= b[0] else b[1].T


class AdditiveModel:
    """Lookup tables of single features and of pairs, with the bins' edges."""

    def __init__(self, base: float, edges: list[np.ndarray], singles: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.base, self.edges, self.singles, self.pairs = base, edges, singles, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        z = np.full(len(x), self.base)
        for b, t in zip(bins, self.singles, strict=True):
            z += t[b]
        for i, j, t in self.pairs:
            z += t[bins[i], bins[j]]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fits labels 0/1. Without rows, or with one label only, every score is the smoothed share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for k in range(n_features)]
    singles = [np.zeros(len(e) + 1) for e in edges]
    if len(set(y.tolist())) < 2:
        return AdditiveModel(base, edges, singles, [])
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    z = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(n_features):
            if not len(edges[k]):
                continue
            g, h = slopes()
            m = len(singles[k])
            step = RATE * _best_cuts(np.bincount(bins[k], g, m), np.bincount(bins[k], h, m))
            singles[k] += step
            z += step[bins[k]]
    g, h = slopes()
    gains = []
    for i, j in combinations([k for k in range(n_features) if len(edges[k])], 2):
        shape = (len(singles[i]), len(singles[j]))
        cell = bins[i] * shape[1] + bins[j]
        grid = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
        leaf = _best_quarters(*grid)
        gains.append((float((grid[0] * leaf).sum()), i, j))
    pairs = [(i, j, np.zeros((len(singles[i]), len(singles[j])))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in pairs:
            g, h = slopes()
            cell = bins[i] * t.shape[1] + bins[j]
            step = RATE * _best_quarters(*(np.bincount(cell, v, t.size).reshape(t.shape) for v in (g, h)))
            t += step
            z += step[bins[i], bins[j]]
    return AdditiveModel(base, edges, singles, pairs)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled rows for which ``learn(doc_id)`` holds, by the smallest hashes of their ids."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(learn(F.col("doc_id")))
    chosen = chosen.select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    # At most ``most`` rows of two numbers.
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, learn, max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fits on labelled documents of ``learn``, at most ``max_rows`` labels; repeated ids bring each of their rows.

    Features are taken by tasks, from whole texts; null texts count as empty,
    null ids and labels are left out. Ids may be of any type. Without labels
    every score is one half. Sets the session's Arrow batch size.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            x = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["k", "y", "x"])

    sample = labelled_sample(docs, labels, "quality", learn, max_rows).select(F.xxhash64("doc_id", "text").alias("k"), "y", "text")
    rows = sample.mapInArrow(run, "k long, y int, x array<double>").toArrow()
    order = np.lexsort((rows.column("y").to_numpy(), rows.column("k").to_numpy()))
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))[order]
    return fit(x, rows.column("y").to_numpy().astype(np.float64)[order])


def score(docs: DataFrame, model: AdditiveModel, name: str = "score") -> DataFrame:
    """``docs`` with a score named ``name``: null and empty texts get the score of a text without words; extra columns stay, but for one of that name."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (name, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            x = np.array([features(t) for t in batch.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in out_names[:-1]] + [pa.array(model.score(x))], out_names)

    from pyspark.sql import types as T

    out_names = [*rest, "text", name]
    schema = T.StructType([*(docs.schema[c] for c in rest), docs.schema["text"], T.StructField(name, T.DoubleType())])
    return docs.select(*rest, "text").mapInArrow(run, schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document; learns from rows whose crc32 of the id, modulo 3, is not 1.

    Null and empty texts get the score of a text without words, very long ones
    are scored whole, repeated rows each get a row, and a null id counts as not
    held out. An empty table gives no rows; without labels all scores are one half.
    """
    model = train(docs, labels, lambda k: crc_mod(k, 3) != 1)
    out = score(docs.select("doc_id", "text"), model).drop("text")
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
