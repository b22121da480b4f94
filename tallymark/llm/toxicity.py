"""Toxicity: a linear-chain conditional random field over words, and scores from its marginals.

Labels are of documents, so words are labelled first: a word or word start
that learning documents hold almost only when they are toxic marks its words
in toxic documents as toxic. The field learns from these labelled lines; its
features are the word, its start and end, its shape and its neighbours.
Forward-backward marginals give the toxic spans, and a logistic fit on sums of
them the document's score.

Chains are whole lines. A line of over ``PIECE`` words is worked on in pieces
side by side; the transfer matrices of its pieces are joined from both ends
first, so that its marginals are those of the whole line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import crc_mod, ragged, small_batches, table, text_slices
from tallymark.llm.quality_classifier import labelled_sample

#: Learning uses at most so many labelled documents, those with the smallest hashes of their ids ...
MAX_ROWS = 20_000
#: ... of at most so many bytes of text in all, as they come to the driver ...
MAX_BYTES = 24 << 20
#: ... and at most so many pieces of their lines, half with labelled words and half without.
MAX_PIECES = 4_000
#: Words of a line that are worked on in one piece; learning takes the pieces as chains.
PIECE = 64
#: A mark is in at least so many toxic documents (more if chance alone would give as many), and this share of its documents is toxic.
MIN_TOXIC = 4
MIN_SHARE = 0.9
DIM = 1 << 17
STEPS = 50
SPAN_AT = 0.5

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^\W+|\W+$")


def _normal(word: bytes) -> str:
    """Lower case, without marks at the ends, or the word itself if it is all marks."""
    w = word.decode("utf-8", "replace").lower()
    return _EDGE.sub("", w) or w


def _starts(w: str) -> list[str]:
    return ["=" + w] + [f"^{k}{w[:k]}" for k in (4, 5, 6) if len(w) > k]


def _hash(s: str) -> int:
    return xxhash.xxh32_intdigest(s.encode()) % DIM


_LENGTH = [_hash(f"#{k}") for k in range(13)]
_SHAPE = {k: _hash("&" + k) for k in "adm"}


def _own_features(w: str) -> list[int]:
    """Feature numbers of a word, its identity first; ten at most."""
    n = len(w)
    return [_hash(x) for x in _starts(w)] + [_hash("$" + w[-k:]) for k in (3, 4) if n > k] + [_LENGTH[min(n, 12)], _SHAPE["a" if w.isalpha() else "d" if w.isdigit() else "m"]]


class _Texts:
    """Words of a batch of texts as codes, with the pieces (chains) of their lines."""

    def __init__(self, texts: list[str | None]):
        self.words: dict[bytes, int] = {}
        codes, doc, chain, follows = [], [], [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            for line in text.encode("utf-8", "replace").split(b"\n"):
                found = [self.words.setdefault(w, len(self.words)) for w in line.split()]
                if found:
                    n = len(found)
                    codes.append(np.array(found, np.int32))
                    doc.append(np.full(n, k, np.int32))
                    chain.append(len(follows) + np.arange(n, dtype=np.int32) // PIECE)
                    follows += [False] + [True] * ((n - 1) // PIECE)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
        self.codes, self.doc, self.chain, self.n_chains = join(codes), join(doc), join(chain), len(follows)
        #: Whether a piece goes on with the line of the piece before it.
        self.follows = np.array(follows, bool)
        self.sizes = np.bincount(self.chain, minlength=self.n_chains) if follows else np.zeros(0, np.int64)


def marked_words(names: list[str], t: _Texts, toxic: np.ndarray) -> np.ndarray:
    """Which words have themselves or a start of them almost only in toxic documents, or twice or more almost only there; names are by code."""
    counts = np.fromiter((len(_starts(w)) for w in names), np.int64, len(names))
    _, start_no = np.unique(np.fromiter((xxhash.xxh3_64_intdigest(s.encode()) for w in names for s in _starts(w)), np.uint64, int(counts.sum())), return_inverse=True)
    first = np.cumsum(counts) - counts
    ends = np.searchsorted(t.doc, np.arange(len(toxic) + 1))
    seen = np.zeros((2, 2, start_no.max(initial=-1) + 1), np.int64)  # [once or more, twice or more][clean, toxic]
    for y, a, b in zip(toxic.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own, n = np.unique(t.codes[a:b], return_counts=True)
        starts = start_no[ragged(first[own], counts[own])]
        here, place = np.unique(starts, return_inverse=True)
        total = np.bincount(place, np.repeat(n, counts[own]), len(here))
        seen[0, y, here] += 1
        seen[1, y, here[total >= 2]] += 1
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    by_chance = np.log(20 * max(1, int((seen[0, 1] > 0).sum()))) / -np.log(share)
    for least in (max(MIN_TOXIC, by_chance), MIN_TOXIC):  # the second for few labels
        found = ((seen[:, 1] >= least) & (seen[:, 1] >= MIN_SHARE * seen.sum(1))).any(0)
        if found.any():
            break
    return np.add.reduceat(found[start_no], first) > 0 if len(names) else np.zeros(0, bool)


class ChainField:
    """Two tags, clean and toxic. Weights are of the toxic tag against the clean one."""

    def __init__(self, own: np.ndarray, near: np.ndarray, trans: np.ndarray, calibration: np.ndarray):
        self.own, self.near, self.trans, self.calibration = own, near, trans, calibration
        self.known: dict[bytes, int] = {}
        self.weights = np.zeros((0, 3))

    def _word_weights(self, words: list[bytes]) -> np.ndarray:
        """(own, as the word before, as the word after) of each word."""
        feats = [_own_features(_normal(w)) for w in words]
        counts = np.fromiter(map(len, feats), np.int64, len(feats))
        flat = np.fromiter((x for f in feats for x in f), np.int64, int(counts.sum()))
        first = np.cumsum(counts) - counts
        return np.stack([np.add.reduceat(self.own[flat], first), self.near[0][flat[first]], self.near[1][flat[first]]], 1)

    def potentials(self, t: _Texts) -> np.ndarray:
        """Of each word, kept by word between batches."""
        if len(self.known) > 400_000:
            self.known, self.weights = {}, np.zeros((0, 3))
        rows = np.fromiter((self.known.setdefault(w, len(self.known)) for w in t.words), np.int64, len(t.words))
        new = [w for w, k in zip(t.words, rows.tolist(), strict=True) if k >= len(self.weights)]
        if new:
            self.weights = np.concatenate([self.weights, self._word_weights(new)])
        each = self.weights[rows]
        e = each[t.codes, 0].copy()
        same = (t.chain[1:] == t.chain[:-1]) | t.follows[t.chain[1:]]
        e[1:] += np.where(same, each[t.codes[:-1], 1], 0)
        e[:-1] += np.where(same, each[t.codes[1:], 2], 0)
        return e

    def marginals(self, t: _Texts) -> np.ndarray:
        """Probability of the toxic tag of each word."""
        if not len(t.codes):
            return np.zeros(0)
        e = self.potentials(t)
        starts = np.cumsum(t.sizes) - t.sizes
        enter, leave = np.ones((t.n_chains, 2)), np.ones((t.n_chains, 2))
        if t.follows.any():
            self._join_pieces(t, e, starts, enter, leave)
        out = np.zeros(len(e))
        for ids, flat, grid, inside in _grids(t.sizes, starts, e, np.arange(t.n_chains)):
            out[flat] = forward_backward(grid, inside, self.trans, enter[ids], leave[ids])[0][inside]
        return out

    def _join_pieces(self, t: _Texts, e: np.ndarray, starts: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> None:
        """Sets what comes into each piece of a long line from the pieces before it, and from those after it."""
        long = t.follows.copy()
        long[:-1] |= t.follows[1:]
        pieces = np.flatnonzero(long)
        m = np.exp(self.trans)
        through = np.ones((t.n_chains, 2, 2))  # [state before, state of the last word]
        for ids, _, grid, inside in _grids(t.sizes, starts, e, pieces):
            top = np.maximum(grid, 0)
            pot = np.exp(np.stack([-top, np.where(inside, grid, 0) - top], 2))
            x = np.where(t.follows[ids, None, None], m, np.ones((2, 2))) * pot[:, :1]
            for k in range(1, grid.shape[1]):
                step = (x @ m) * pot[:, k, None]
                x = np.where(inside[:, k, None, None], step / step.max((1, 2), keepdims=True), x)
            through[ids] = x
        first = pieces[~t.follows[pieces]]
        count = np.diff(np.append(np.flatnonzero(~t.follows[pieces]), len(pieces)))
        alpha = through[first, 0]
        for j in range(1, int(count.max())):
            on = count > j
            k = first[on] + j
            enter[k] = alpha[on] @ m
            alpha[on] = (alpha[on][:, None] @ through[k])[:, 0]
            alpha[on] /= alpha[on].sum(1, keepdims=True)
        beta = np.ones((len(first), 2))
        for j in range(int(count.max()) - 1, 0, -1):
            on = count > j
            k = first[on] + j
            beta[on] = (through[k] @ beta[on][:, :, None])[:, :, 0]
            beta[on] /= beta[on].sum(1, keepdims=True)
            leave[k - 1] = beta[on]

    def spans(self, text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
        """(first character, character after, highest marginal) of runs of toxic words; p is by word of the text."""
        b = text.encode("utf-8", "replace")
        out: list[list] = []
        last = None
        for k, m in enumerate(_WORD.finditer(b)):
            if p[k] >= SPAN_AT:
                if out and last == k - 1:
                    out[-1][1], out[-1][2] = m.end(), max(out[-1][2], float(p[k]))
                else:
                    out.append([m.start(), m.end(), float(p[k])])
                last = k
        return [(len(b[:s].decode("utf-8", "replace")), len(b[:e].decode("utf-8", "replace")), q) for s, e, q in out]

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.calibration[0] + sums @ self.calibration[1:])))


def _grids(sizes: np.ndarray, starts: np.ndarray, e: np.ndarray, chains: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(chains, places of their words, padded potentials, which are words) for chains of about one length at a time."""
    order = chains[np.argsort(-sizes[chains], kind="stable")]
    for a in range(0, len(order), 4096):
        ids = order[a : a + 4096]
        n = int(sizes[ids[0]])
        grid = np.full((len(ids), n), -np.inf)
        inside = np.arange(n)[None, :] < sizes[ids][:, None]
        flat = ragged(starts[ids], sizes[ids])
        grid[inside] = e[flat]
        yield ids, flat, grid, inside


def forward_backward(e: np.ndarray, inside: np.ndarray, trans: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(toxic marginals, expected transitions [2, 2], log partition sums) of padded chains.

    ``e``: log potential of the toxic tag at each place; the clean tag has 0.
    ``enter`` and ``leave`` weigh the tags of the first and last word by what
    lies before and after a chain; without them there is nothing.
    """
    n_rows, n = e.shape
    pot = np.zeros((n_rows, n, 2))
    pot[:, :, 1] = np.where(inside, e, 0)
    m = np.exp(trans)
    top = pot.max(2)
    pot = np.exp(pot - top[:, :, None])
    enter, leave = (np.ones((n_rows, 2)) if x is None else x for x in (enter, leave))
    alpha, beta = np.zeros((n_rows, n, 2)), np.repeat(leave[:, None], n, 1)
    scale = np.ones((n_rows, n))
    a = pot[:, 0] * enter
    for k in range(n):
        if k:
            a = (alpha[:, k - 1] @ m) * pot[:, k]
            a = np.where(inside[:, k, None], a, alpha[:, k - 1])
        s = a.sum(1)
        alpha[:, k] = a / s[:, None]
        scale[:, k] = np.where(inside[:, k], s, 1)
    for k in range(n - 2, -1, -1):
        b = (beta[:, k + 1] * pot[:, k + 1]) @ m.T
        b /= b.sum(1)[:, None]
        beta[:, k] = np.where(inside[:, k + 1, None], b, leave)
    post = alpha * beta
    marginal = post[:, :, 1] / post.sum(2)
    joint = alpha[:, :-1, :, None] * m[None, None] * (pot[:, 1:] * beta[:, 1:])[:, :, None, :]
    joint /= np.maximum(joint.sum((2, 3), keepdims=True), 1e-300)
    expected = (joint * inside[:, 1:, None, None]).sum((0, 1))
    return marginal, expected, np.log(scale).sum(1) + np.where(inside, top, 0).sum(1)


def _fit_field(chains: list[list[str]], tags: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by gradient steps (Adam) on the regularised likelihood of tagged chains."""
    own, near, trans = np.zeros(DIM), np.zeros((2, DIM)), np.zeros((2, 2))
    if not chains:
        own -= 1.0
        return own, near, trans
    words = {w: k for k, w in enumerate(dict.fromkeys(w for c in chains for w in c))}
    feats = np.full((len(words), 10), DIM, np.int64)
    for w, k in words.items():
        f = _own_features(w)
        feats[k, : len(f)] = f
    n = max(map(len, chains))
    inside = np.zeros((len(chains), n), bool)
    codes = np.zeros((len(chains), n), np.int64)
    y = np.zeros((len(chains), n))
    for k, (c, t) in enumerate(zip(chains, tags, strict=True)):
        inside[k, : len(c)] = True
        codes[k, : len(c)] = [words[w] for w in c]
        y[k, : len(c)] = t
    yi = y.astype(np.int64)
    both = inside[:, 1:]
    seen = np.bincount((yi[:, :-1] * 2 + yi[:, 1:])[both], minlength=4).reshape(2, 2).astype(float)
    flat = codes[inside]
    before, after = both & inside[:, :-1], both
    params = [np.zeros(DIM + 1), np.zeros((2, DIM)), np.zeros((2, 2)), np.full(1, -2.0)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        w, nr, tr, bias = params
        each = w[feats].sum(1) + bias[0]
        e = each[codes]
        first = feats[:, 0]
        e[:, 1:] += np.where(before, nr[0][first[codes[:, :-1]]], 0)
        e[:, :-1] += np.where(after, nr[1][first[codes[:, 1:]]], 0)
        marginal, expected, _ = forward_backward(e, inside, tr)
        diff = np.where(inside, y - marginal, 0)
        by_word = np.bincount(flat, diff[inside], len(words))
        g_own = np.bincount(feats.ravel(), np.repeat(by_word, feats.shape[1]), DIM + 1)
        g_own[DIM] = 0
        g_near = np.stack([np.bincount(first[codes[:, :-1]][before], diff[:, 1:][before], DIM), np.bincount(first[codes[:, 1:]][after], diff[:, :-1][after], DIM)])
        grads = [g_own - 0.05 * w, g_near - 0.5 * nr, seen - expected - 0.05 * tr, np.array([by_word.sum()])]
        for p, g, (m1, m2) in zip(params, grads, moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    w, nr, tr, bias = params
    own = w[:DIM].copy()
    # Every word has one feature of its length class, so the bias is spread over these.
    for k in range(13):
        own[_LENGTH[k]] += bias[0]
    return own, nr, tr


def _sums(t: _Texts, p: np.ndarray, n_docs: int) -> np.ndarray:
    """By document: log odds of any toxic word, whether a word is toxic, log of the expected number of toxic words."""
    clean = np.zeros(n_docs)
    np.add.at(clean, t.doc, np.log1p(-np.minimum(p, 1 - 1e-9)))
    any_ = -np.expm1(clean)
    high = np.zeros(n_docs)
    np.maximum.at(high, t.doc, p)
    expected = np.bincount(t.doc, p, n_docs) if len(p) else np.zeros(n_docs)
    odds = np.log(np.maximum(any_, 1e-9)) - np.minimum(clean, 0)
    return np.stack([np.clip(odds, -12, 12), high >= SPAN_AT, np.log1p(expected)], 1)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a small penalty."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-3] + [1.0] * x.shape[1])
        w += np.linalg.solve(h, z.T @ (y - p) - np.array([1e-3] + [1.0] * x.shape[1]) * w)
    return w


def fit(texts: list[str], toxic: np.ndarray, max_pieces: int = MAX_PIECES) -> ChainField:
    """Learns from whole texts with labels 0/1, whose list it empties; the field from at most ``max_pieces`` pieces of them, evenly apart.

    Without toxic texts every score is the smoothed share of them.
    """
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    t, n_docs = _Texts(texts), len(texts)
    texts.clear()  # the codes stand for them, and memory is short on a driver
    names = [_normal(w) for w in t.words]
    marked = marked_words(names, t, toxic)
    if not marked.any() or len(set(toxic.tolist())) < 2:
        own, near, trans = _fit_field([], [])
        return ChainField(own, near, trans, np.array([np.log(share / (1 - share)), 0, 0, 0]))
    tag = marked[t.codes] & (toxic[t.doc] == 1)
    with_tag = np.bincount(t.chain, tag, t.n_chains) > 0
    order = np.concatenate([x[np.linspace(0, len(x) - 1, min(len(x), max_pieces // 2)).astype(np.int64)] for x in (np.flatnonzero(with_tag), np.flatnonzero(~with_tag))])
    starts = np.cumsum(t.sizes) - t.sizes
    chains = [[names[c] for c in t.codes[starts[k] : starts[k] + t.sizes[k]].tolist()] for k in order.tolist()]
    tags = [tag[starts[k] : starts[k] + t.sizes[k]].astype(int).tolist() for k in order.tolist()]
    field = ChainField(*_fit_field(chains, tags), np.zeros(4))
    field.calibration = _calibrate(_sums(t, field.marginals(t), n_docs), toxic.astype(np.float64))
    field.known, field.weights = {}, np.zeros((0, 3))
    return field


def train(docs: DataFrame, labels: DataFrame, learn, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, max_pieces: int = MAX_PIECES) -> ChainField:
    """Learns from a bounded sample of labelled documents, whose texts come to the driver.

    Null texts count as empty, null labels and ids are left out, and repeated
    ids bring each of their rows. Documents are taken in the order of hashes
    until ``max_bytes`` are full; ids whose texts hold more than an eighth of
    that are passed over, so that one long text doesn't keep all others out.
    Without labels every score is one half.
    """
    sample = labelled_sample(docs, labels, "toxic", learn, max_rows)
    # Two numbers of at most ``max_rows`` documents, then the texts that fit.
    sizes = sample.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.first(F.xxhash64("doc_id")).alias("h")).toArrow()
    n = sizes.column("n").to_numpy()
    order = np.lexsort((sizes.column("doc_id").to_numpy(), sizes.column("h").to_numpy()))
    order = order[n[order] <= max_bytes // 8]
    kept = order[: np.searchsorted(np.cumsum(n[order]), max_bytes, side="right")]
    long_ones = sizes.filter(pa.array(n > max_bytes // 8)).column("doc_id").to_pylist()
    fits = F.xxhash64("doc_id") <= F.lit(sizes.column("h")[int(kept[-1])].as_py()) if len(kept) else F.lit(False)
    if long_ones:
        fits = fits & ~F.col("doc_id").isin(long_ones)
    got = sample.where(fits).select("doc_id", "y", "text").toArrow()
    got = got.take(np.lexsort((got.column("y").to_numpy(), got.column("doc_id").to_numpy())))
    toxic, texts = got.column("y").to_numpy().astype(np.int64), [x or "" for x in got.column("text").to_pylist()]
    del got
    return fit(texts, toxic, max_pieces)


def tag(docs: DataFrame, field: ChainField) -> DataFrame:
    """doc_id, score and the toxic spans (first character, character after, marginal) of every text.

    Null and empty texts have no spans and the score of no toxic word. Rows
    are scored one by one, so repeated ids give repeated rows. Lines of any
    length are one chain each. An empty table gives no rows. Other columns are
    not read. Sets the session's Arrow batch size.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            t = _Texts(texts)
            p = field.marginals(t)
            sums = _sums(t, p, len(texts))
            ends = np.searchsorted(t.doc, np.arange(len(texts) + 1))
            spans = [[{"first": s, "after": e, "marginal": q} for s, e, q in field.spans(texts[k], p[a:b])] if b > a and p[a:b].max() >= SPAN_AT else [] for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(field.score(sums)), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("marginal", pa.float64())])))], ["doc_id", "score", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<first:long,after:long,marginal:double>>")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = tag(docs, train(docs, table(spark, sf_dir, "labels"), lambda k: crc_mod(k, 5) != 0))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
