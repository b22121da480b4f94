"""Near-duplicate documents: Jaccard similarity join of word five-grams by chosen paths.

Documents with equal sets are one class with a count. A class's set is
embedded as ``COORDINATES`` (coordinate, minimum) tokens; a path names one of
them at each step, the same for all sets that reach its node, and sets that
share the token go on together. Nodes with at most ``SMALL`` sets are compared
by brute force; larger ones split again by two tokens. Nodes that splitting
would not make smaller, because their sets are alike, are compared in blocks.
Each run starts with a coordinate of its own; runs are repeated until a pair at
the threshold meets with the target recall.

A pair that meets in several nodes is counted in the first of them only, which
each task sees from the lists of nodes that sets carry; so tasks return sums
and spanning links for each set and never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.llm.common import components, dropped, mix64, small_batches, sorted_groups, stored, table, text_slices

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999999
COORDINATES = 96
SMALL = 256
BRANCHES = 2
DEPTH = 5
#: A node is dense if its children hold this share of it, on average over its sets.
DENSE = 0.5
BLOCK_SETS = 1024
BLOCK_TOKENS = 1 << 20
#: Bytes of sets that a task sends at a time.
SENT_BYTES = 4 << 20

_RNG = np.random.default_rng(71)
_MUL = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def missed(runs: int, threshold: float, depth: int = DEPTH) -> float:
    """Chance that a pair at the threshold meets in no run.

    All runs use the same coordinates, so the chance is that of each number
    of coordinates that the pair may agree in, weighed by how likely it is. A
    run starts with one coordinate, and a node splits by two, ``depth`` - 1
    times at most.
    """
    total = 0.0
    for k in range(COORDINATES + 1):
        share, p = k / COORDINATES, 1.0
        for _ in range(depth - 1):
            p = 1 - (1 - share * p) ** BRANCHES
        total += math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k) * (1 - share * p) ** runs
    return total


def runs_for(recall: float, threshold: float) -> int:
    """The fewest runs that miss a pair at the threshold with probability 1 - recall at most."""
    return next((r for r in range(1, COORDINATES) if missed(r, threshold) <= 1 - recall), COORDINATES)


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a shorter text with words is one gram."""
    known: dict[bytes, int] = {}
    codes = []
    for text in texts:
        words = text.encode("utf-8", "replace").split() if text else []
        codes.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    out = []
    with np.errstate(over="ignore"):
        for c in codes:
            h = hashes[c]
            if len(h) < n:
                x = np.array([len(h)], np.uint64)
                for w in h:
                    x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + w)
                out.append(x if len(h) else np.zeros(0, np.uint64))
                continue
            x = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
            out.append(np.unique(mix64(x)))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum of each of ``COORDINATES`` hashes of a set (uint32)."""
    out = np.empty(COORDINATES, np.uint64)
    step = max(1, (1 << 20) // max(1, len(s)))
    with np.errstate(over="ignore"):
        for k in range(0, COORDINATES, step):
            out[k : k + step] = (s[None, :] * _MUL[k : k + step, None] + _ADD[k : k + step, None]).min(1)
    return (out >> np.uint64(32)).astype(np.uint32)


def _key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _child(node: np.ndarray, branch: int, sigs: np.ndarray, coordinate: int | None = None) -> np.ndarray:
    """Node that each set reaches from ``node`` by the branch's coordinate, or by the one that is named."""
    with np.errstate(over="ignore"):
        seed = mix64(node + np.uint64(branch + 1) * np.uint64(0xD6E8FEB86659FD93))
        c = (seed >> np.uint64(20)) % np.uint64(COORDINATES) if coordinate is None else np.full(len(node), coordinate)
        return mix64(seed * np.uint64(0x9E3779B97F4A7C15) + sigs[np.arange(len(sigs)), c.astype(np.int64)].astype(np.uint64))


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _node_sums(rows: DataFrame, *by: str) -> DataFrame:
    """Size, tokens and two member checksums of nodes with two members or more."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("tokens"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2")).where("n > 1")


def _nodes(classes: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """(rep, m, node) memberships, and the nodes to be compared: node, n, tokens."""
    kind = classes.schema["rep"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sigs = _sigs(batch.column("sig"))
            nodes = np.concatenate([_child(np.full(n, r, np.uint64), 7 + r, sigs, r % COORDINATES) for r in range(runs)])
            take = pa.array(np.tile(np.arange(n), runs))
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(take), batch.column("m").take(take), pa.array(nodes.view(np.int64))], ["rep", "m", "node"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sigs, parent = _sigs(batch.column("sig")), batch.column("node").to_numpy()
            nodes = np.concatenate([_child(parent.view(np.uint64), b, sigs) for b in range(BRANCHES)])
            take = pa.array(np.tile(np.arange(n), BRANCHES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("rep", "m", "node", "n")), pa.array(nodes.view(np.int64))], ["rep", "m", "parent", "size", "node"])

    rows = stored(classes.select("rep", "m", "sig").mapInArrow(first, f"rep {kind}, m long, node long"), "join-rows")
    members, leaves = [], []
    for depth in range(1, DEPTH + 1):
        sums = stored(_node_sums(rows, "node"), "join-nodes")
        members.append(rows)
        leaves.append(sums.where(F.col("n") <= SMALL) if depth < DEPTH else sums)
        big = sums.where(F.col("n") > SMALL)
        if depth == DEPTH or big.isEmpty():
            break
        kids = rows.join(big.select("node", "n"), "node").select("rep", "m", "node", "n").join(classes.select("rep", "sig"), "rep")
        kids = stored(kids.mapInArrow(split, f"rep {kind}, m long, parent long, size long, node long"), "join-children")
        spread = kids.groupBy("parent", "size", "node").agg(F.count(F.lit(1)).alias("c")).groupBy("parent").agg((F.sum(F.col("c") * F.col("c")) / (BRANCHES * F.max("size") * F.max("size"))).alias("share"))
        spread = stored(spread, "join-spread")
        leaves.append(big.join(spread.where(F.col("share") >= DENSE).select(F.col("parent").alias("node")), "node", "left_semi"))
        rows = kids.join(spread.where(F.col("share") < DENSE).select("parent"), "parent", "left_semi").select("rep", "m", "node")
        rows = stored(rows, "join-rows")
        dropped(kids)
    all_leaves, all_rows = leaves[0], members[0]
    for x in leaves[1:]:
        all_leaves = all_leaves.unionByName(x)
    for x in members[1:]:
        all_rows = all_rows.unionByName(x)
    # Runs often find the same members again; one node of each such kind is enough.
    all_leaves = all_leaves.groupBy("n", "tokens", "x1", "x2").agg(F.min("node").alias("node")).select("node", "n", "tokens")
    return all_rows, all_leaves


def _pairs(sets: list[np.ndarray], m: np.ndarray, earlier: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: Fraction, same: bool) -> np.ndarray:
    """Which pairs (of places a and b) reach the threshold and share no earlier node."""
    def shared(lists: list[np.ndarray]) -> np.ndarray:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        _, col, count = np.unique(np.concatenate(lists) if len(lists) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(lists)), sizes)
        keep = count[col] > 1
        row, col = row[keep], col[keep]
        used, col = np.unique(col, return_inverse=True)
        out = np.zeros((len(a), len(b)), np.float32)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for lo in range(0, len(used), 4096):
            s, e = np.searchsorted(col, [lo, lo + 4096])
            grid = np.zeros((len(lists), min(4096, len(used) - lo)), np.float32)
            grid[row[s:e], col[s:e] - lo] = 1
            out += grid[a] @ grid[b].T
        return out

    # i / (ma + mb - i) >= p / q, as i * (p + q) >= p * (ma + mb), row by row.
    inter = shared(sets)
    p, q = threshold.numerator, threshold.denominator
    good = np.empty(inter.shape, bool)
    for k in range(len(a)):
        good[k] = inter[k].astype(np.int64) * (p + q) >= p * (m[a[k]] + m[b])
    del inter
    if same:
        good &= ~np.eye(len(a), dtype=bool)
    if good.any() and any(len(e) for e in earlier):
        good &= shared(earlier) == 0
    return good


def _roots(good: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place that each place is linked with, over any number of links."""
    root = np.arange(n)
    big = n
    while True:
        new = root.copy()
        new[a] = np.minimum(new[a], np.where(good, root[b][None, :], big).min(1, initial=big))
        new[b] = np.minimum(new[b], np.where(good, root[a][:, None], big).min(0, initial=big))
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per document: class_id, n_links, copy_id, n_shingles and kept.

    ``class_id`` is the smallest id that links reach, ``copy_id`` the smallest
    id with an equal set, ``n_links`` the number of other documents at or above
    the threshold, copies included. Texts of one to four words are one gram;
    null texts and texts without words, and rows with a null id, link with
    nothing. Repeated rows are copies of each other. Texts are read whole, however
    long; an empty table gives no rows. Other columns are not read. Sets the
    session's Arrow batch size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ratio = Fraction(threshold).limit_denominator(1000)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist())
            keys = [_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], ["doc_id", "k1", "k2", "m", "sig"])

    base = stored(given.mapInArrow(embed, f"doc_id {kind}, k1 long, k2 long, m long, sig binary"), "join-base")
    usable = base.where("m > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("m").alias("m"), F.max("sig").alias("sig")), "join-classes")
    rows, leaves = _nodes(classes, runs_for(recall, threshold))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    member = rows.join(leaves.select("node", blocks.alias("blocks")), "node").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("node", "blocks"))).alias("nodes"))
    # A repeated id may have several texts: the key tells which of them the class is.
    member = member.join(classes.select("rep", "k1", "k2", "copies"), "rep")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("node", "p", "q", "second", "rep", "copies", "tokens", "earlier")
        schema = None

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in text_slices(batches, "text", 1 << 20):
            schema = schema or pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), batch.schema.field("rep").type, pa.int64(), pa.binary(), pa.binary()), strict=True)))
            sets = shingle_sets(batch.column("text").to_pylist())
            out, held = [], 0
            for rep, s, k1, k2, copies, nodes in zip(batch.column("rep").to_pylist(), sets, *(batch.column(c).to_pylist() for c in ("k1", "k2", "copies", "nodes")), strict=True):
                if _key(s) != (k1, k2):
                    continue
                ids = np.array([x["node"] for x in nodes], np.int64)
                data = s.tobytes()
                own = xxhash.xxh3_64_intdigest(str(rep).encode())
                for x in nodes:
                    mine = own % x["blocks"]
                    before = ids[ids < x["node"]].tobytes()
                    for other in range(x["blocks"]):
                        out.append((x["node"], min(mine, other), max(mine, other), mine > other, rep, copies, data, before))
                        held += len(data) + len(before)
                        if held >= SENT_BYTES:
                            yield rows_of(out)
                            out, held = [], 0
            if out:
                yield rows_of(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["node", "p", "q"]):
            rep = np.array(group.column("rep").to_pylist())
            _, order = np.unique(rep, return_index=True)  # by rising rep, repeated rows once
            if len(order) < 2:
                continue
            rep = rep[order]
            copies, second = group.column("copies").to_numpy()[order], group.column("second").to_numpy()[order].astype(bool)
            tokens, before = group.column("tokens"), group.column("earlier")
            sets = [np.frombuffer(tokens[k].as_buffer(), np.uint64) for k in order.tolist()]
            earlier = [np.frombuffer(before[k].as_buffer(), np.int64) for k in order.tolist()]
            m = np.fromiter(map(len, sets), np.int64, len(sets))
            same = not second.any()
            a = np.flatnonzero(~second)
            b = a if same else np.flatnonzero(second)
            if not len(a):
                continue
            good = _pairs(sets, m, earlier, a, b, ratio, same)
            links = np.zeros(len(rep), np.int64)
            links[a] += good @ copies[b]
            if not same:
                links[b] += good.T @ copies[a]
            some = links > 0
            if some.any():
                root = rep[_roots(good, a, b, len(rep))]
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(root[some])], ["rep", "links", "root"])

    texts = given.join(member, given["doc_id"] == member["rep"]).select("rep", "text", "k1", "k2", "copies", "nodes")
    dealt = texts.mapInArrow(tasks, f"node long, p long, q long, second boolean, rep {kind}, copies long, tokens binary, earlier binary")
    dealt = dealt.repartition("node", "p", "q").sortWithinPartitions("node", "p", "q")
    found = stored(dealt.mapInArrow(compare, f"rep {kind}, links long, root {kind}"), "join-links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(spark, found.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b")), "join")
    known = classes.select("k1", "k2", "rep", "copies").join(sums, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("k1", "k2", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    keyed = base.select("doc_id", "m", F.when((F.col("m") > 0) & F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2")
    out = keyed.join(known, ["k1", "k2"], "left")
    cls = F.coalesce("component", "doc_id")
    return out.select("doc_id", cls.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep", "doc_id").alias("copy_id"), F.col("m").alias("n_shingles"), F.coalesce(F.col("doc_id") == cls, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: of each class the one with the smallest id, once if rows repeat it.

    Null and empty texts are classes of their own and stay, as do all rows
    with a null id. Columns of any name are carried as they are.
    """
    stay = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("stay")).distinct()
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("k"), F.xxhash64("text").alias("t"))
    kept = named.join(stay, F.col("k").eqNullSafe(F.col("stay")))
    once = F.row_number().over(W.partitionBy("k", "t").orderBy(F.lit(1)))
    known = kept.where("k IS NOT NULL").withColumn("place", once).where("place = 1").select("row.*")
    return known.unionByName(kept.where("k IS NULL").select("row.*"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
