"""Near-duplicate vectors by a PCA-ordered, tiled comparison.

Vectors are scaled to length one and turned so that the leading dimensions
hold most of the variance. Two vectors with cosine c lie sqrt(2 - 2c) apart.
Each vector belongs to the cell of its nearest pivot, and pivots are the
centroids of a bounded sample; they only decide who meets whom. A vector visits
another cell of its label if it lies within that distance of the plane half-way
to the other pivot, and within it of the ball that holds the other cell: no
other cell can hold a link of its. Of two cells one is visited by the other's
vectors.

A task holds a part of a cell and reads its visitors as a stream, a chunk at a
time, so its memory is that of a part whatever comes to it. Vectors are
compared tile by tile, and pairs of tiles are left out by their boxes; the rest
are compared by adding up leading dimensions first, where the norms of the
suffixes bound what is left of a product. Pairs that reach the threshold by the
bound are checked in double precision on the given components, which are only
scaled by a power of two, so that no square leaves the range of doubles.

Equal vectors are one row with a count. Tasks return sums and spanning links
for each vector, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import components, small_batches, stored, table

THRESHOLD = 0.98
#: Bytes of vectors of a part of a cell, which one task holds, and visitors that it compares at a time.
BLOCK_BYTES = 16 << 20
CHUNK = 4096
#: Vectors that pivots are fitted to, at most, and their bytes; passes over them; pivots at most.
SAMPLE = 8192
SAMPLE_BYTES = 16 << 20
PASSES = 5
MOST_PIVOTS = 512
#: Rows of the table of cells that is broadcast (some 50 bytes each); a longer one is joined by a shuffle.
BROADCAST_ROWS = 100_000
TILE = 2048
STAGES = (8, 24)
SLACK = 1e-9
#: What rounding may add to a distance.
ROUNDING = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of components, each scaled by the power of two that brings its largest one under 1: cosines stay what they are."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns are the directions of falling variance of all unit vectors; sums are taken by tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = _unit(_matrix(batch.column("v"), dim))
            n, one, two = n + len(x), one + x.sum(0), two + x.T @ x
        if n:
            values = np.concatenate([[n], one, two.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["k", "s"])

    got = vectors.select("v").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()
    sums = np.zeros(1 + dim + dim * dim)
    sums[got.column("k").to_numpy()] = got.column("s").to_numpy()
    if not sums[0]:
        return np.eye(dim)
    mean = sums[1 : dim + 1] / sums[0]
    cov = sums[dim + 1 :].reshape(dim, dim) / sums[0] - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    return axes[:, np.argsort(-values)]


def compare(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked pairs of two tiles, with i < j if the tiles are one."""
    dim = a.shape[1]
    low = threshold - SLACK
    ends = [*(s for s in STAGES if s < dim), dim]
    part = turned_a[:, : ends[0]] @ turned_b[:, : ends[0]].T
    rest = lambda t, k: np.sqrt(np.maximum(0, (t[:, k:] ** 2).sum(1)))
    alive = part + rest(turned_a, ends[0])[:, None] * rest(turned_b, ends[0])[None, :] >= low
    if same:
        alive &= np.triu(np.ones(alive.shape, bool), 1)
    i, j = np.nonzero(alive)
    acc = part[i, j]
    for lo, hi in zip(ends, ends[1:], strict=False):
        if not len(i):
            break
        keep = np.zeros(len(i), bool)
        ra, rb = rest(turned_a, hi), rest(turned_b, hi)
        for s in range(0, len(i), 1 << 18):
            p, q = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            acc[s : s + len(p)] += np.einsum("ij,ij->i", turned_a[p, lo:hi], turned_b[q, lo:hi])
            keep[s : s + len(p)] = acc[s : s + len(p)] + ra[p] * rb[q] >= low
        i, j, acc = i[keep], j[keep], acc[keep]
    good = np.zeros(len(i), bool)
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    for s in range(0, len(i), 1 << 18):
        p, q = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
        good[s : s + len(p)] = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) >= threshold
    return i[good], j[good]


def compare_blocks(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, threshold: float, same: bool, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked pairs of two blocks, tile by tile; pairs of one block come once."""
    far = max(0.0, 2 - 2 * threshold) + SLACK

    def tiles(turned: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        order = np.argsort(turned[:, 0], kind="stable")
        cuts = [order[k : k + tile] for k in range(0, len(order), tile)]
        lead = [turned[c, : STAGES[0]] for c in cuts]
        return cuts, np.array([x.min(0) for x in lead]), np.array([x.max(0) for x in lead])

    ta, lo_a, hi_a = tiles(turned_a)
    tb, lo_b, hi_b = (ta, lo_a, hi_a) if same else tiles(turned_b)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k, x in enumerate(ta):
        gap = np.maximum(0, np.maximum(lo_a[k] - hi_b, lo_b - hi_a[k]))
        for q in np.flatnonzero((gap * gap).sum(1) <= far).tolist():
            if same and q < k:
                continue
            y = tb[q]
            i, j = compare(a[x], b[y], turned_a[x], turned_b[y], threshold, same and q == k)
            found.append((x[i], y[j]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is linked with, over any number of links."""
    root = np.arange(n)
    while len(i):
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    return root


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: n_links, component_id and kept.

    Vectors are linked within a label by cosine >= ``threshold``. A null label,
    a null, empty or zero vector, and one with null or non-finite components
    link with nothing. Vectors of different lengths are never linked; each length
    takes a round of its own. Repeated
    rows count as vectors of their own and link with each other. A null vec_id
    links with nothing. An empty table gives no rows. Other columns are not
    read. Sets the session's Arrow batch size.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    plain = F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    d = d.withColumn("v", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & plain, F.transform("v", lambda x: x + F.lit(0.0))))
    d = d.withColumn("h", F.xxhash64("v", F.lit(1)))
    usable = d.where("v IS NOT NULL")
    classes = usable.groupBy("label", "h", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # A repeated vec_id may stand for several vectors, so classes have numbers of their own.
    classes = stored(classes.withColumn("no", F.monotonically_increasing_id()), "vectors")
    dims = [r.k for r in classes.select(F.size("v").alias("k")).distinct().collect()]
    if not dims:
        return d.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # One length, unless vectors of several lengths are mixed.
    found = stored(reduce(DataFrame.unionByName, [_links(classes.where(F.size("v") == dim), dim, threshold) for dim in dims]), "vector-links")
    sums = found.groupBy("no").agg(F.sum("links").alias("links"))
    comps = components(spark, found.where("root <> no").select(F.col("no").alias("a"), F.col("root").alias("b")), "vectors").withColumnRenamed("node", "no")
    least = comps.join(classes.select("no", "rep"), "no").groupBy("component").agg(F.min("rep").alias("first"))
    known = classes.join(sums, "no", "left").join(comps.join(least, "component").select("no", "first"), "no", "left")
    known = known.select("label", "h", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("first", "rep").alias("component"))
    # h is a hash of the components: equal vectors have equal h, and v tells others apart.
    out = d.join(known, ["label", "h", "v"], "left")
    comp = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


def pivots(vectors: DataFrame, axes: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` different points, the centroids of a sample by hash, in turned coordinates. The sample's size is bounded."""
    dim = len(axes)
    n = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * dim)))
    k = min(k, max(1, n // 8))
    if k == 1:
        return np.zeros((1, dim))
    sample = vectors.select("v").orderBy(F.xxhash64("no", F.lit(3))).limit(n).toArrow()
    x = _unit(_matrix(sample.column("v"), dim)) @ axes
    at = np.unique(x[:k], axis=0)
    for _ in range(PASSES):
        near = _squares(x, at).argmin(1)
        counts = np.bincount(near, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, near, x)
        at = np.unique(sums[counts > 0] / counts[counts > 0][:, None], axis=0)
    return at


def _squares(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of rows to points."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ at.T) + (at * at).sum(1)[None, :])


def visits(x: np.ndarray, at: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's own cell; and (row, cell, distance to its pivot) of that and of all others whose vectors may be within ``far``."""
    d2 = _squares(x, at)
    own = d2.argmin(1)
    gaps = np.sqrt(_squares(at, at))
    # A vector of another cell lies beyond the plane half-way between the pivots.
    near = d2 - d2[np.arange(len(x)), own][:, None] <= 2 * far * gaps[own] + ROUNDING
    near[np.arange(len(x)), own] = True
    row, cell = np.nonzero(near)
    return own, row, cell, np.sqrt(d2[row, cell])


def _visited(host: Column, guest: Column) -> Column:
    """Of two different numbers, whether the first is the one that is visited; each is by about half of the others."""
    return ((host + guest) % 2 == 1) == (host < guest)


def meetings(classes: DataFrame, dim: int, threshold: float, most: int, cell: int = TILE) -> tuple[DataFrame, np.ndarray]:
    """(no, n, v, task, task2, guest): the vectors of each part of a cell, and those that visit it; and the turned axes.

    ``most`` is the number of vectors of a part, ``cell`` the number that a
    label's cells hold about.
    """
    axes = rotation(classes, dim)
    far = np.sqrt(max(0.0, 2 - 2 * threshold)) + ROUNDING
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    at = pivots(classes, axes, min(MOST_PIVOTS, -(-largest // cell)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("v"), dim)) @ axes
            own, row, cells, d = visits(x, at, far)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]).astype(np.int32)
            ways = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(cells.astype(np.int32)), pa.array(d)], ["cell", "d"]))
            yield pa.RecordBatch.from_arrays([batch.column("no"), batch.column("label"), batch.column("n"), batch.column("v"), pa.array(own.astype(np.int32)), pa.array(d[cells == own[row]]), ways], ["no", "label", "n", "v", "own", "near", "ways"])

    kind = classes.schema["label"].dataType.simpleString()
    placed = classes.select("no", "label", "n", "v").mapInArrow(place, f"no long, label {kind}, n long, v array<double>, own int, near double, ways array<struct<cell: int, d: double>>")
    placed = stored(placed, "vector-cells")
    cells = placed.groupBy("label", F.col("own").alias("cell")).agg(F.max("near").alias("radius"), F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    cells = stored(cells, "vector-parts")
    if cells.count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    d = placed.select("no", "label", "n", "v", "own", F.explode("ways").alias("way")).select("no", "label", "n", "v", "own", "way.cell", "way.d")
    d = d.where((F.col("cell") == F.col("own")) | _visited(F.col("cell"), F.col("own"))).join(cells, ["label", "cell"])
    home = F.col("cell") == F.col("own")
    d = d.where(home | (F.col("d") <= F.col("radius") + far))
    mine = F.pmod(F.xxhash64("no", F.lit(7)), F.col("parts")).cast("int")
    parts = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: ~home | (p == F.col("mine")) | _visited(p, F.col("mine")))
    d = d.withColumn("mine", mine).withColumn("part", F.explode(parts))
    names = ("label", "cell", "part")
    return d.select("no", "n", "v", F.xxhash64(*names).alias("task"), F.xxhash64(F.lit(2), *names).alias("task2"), (~home | (F.col("part") != F.col("mine"))).alias("guest")), axes


def _links(classes: DataFrame, dim: int, threshold: float, block: int | None = None, cell: int = TILE) -> DataFrame:
    """(no, links, root): parts of each vector's links, and local spanning links."""
    d, axes = meetings(classes, dim, threshold, block or max(TILE, BLOCK_BYTES // (8 * dim)), cell)

    def compared(home: tuple, other: tuple | None) -> pa.RecordBatch:
        """Links among the vectors of a part, or between them and a chunk of visitors."""
        no, n, x, turned = home
        if other is None:
            i, j = compare_blocks(x, x, turned, turned, threshold, True)
        else:
            i, j = compare_blocks(x, other[2], turned, other[3], threshold, False)
            no, n, j = np.concatenate([no, other[0]]), np.concatenate([n, other[1]]), j + len(x)
        links = np.bincount(i, n[j], len(no)) + np.bincount(j, n[i], len(no))
        root = no[local_roots(len(no), i, j)]
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(no[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], ["no", "links", "root"])

    def arrays(rows: pa.Table) -> tuple:
        x = _matrix(rows.column("v"), dim)
        return rows.column("no").to_numpy(), rows.column("n").to_numpy(), x, _unit(x) @ axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, home = None, [], None
        for rows in _chunks(batches):
            key, guest = (rows.column("task")[0].as_py(), rows.column("task2")[0].as_py()), rows.column("guest")[0].as_py()
            if key != task:
                if held:
                    yield compared(arrays(pa.Table.from_batches(held)), None)
                task, held, home = key, [], None
            if not guest:
                held.append(rows)
                continue
            if held:
                home, held = arrays(pa.Table.from_batches(held)), []
                yield compared(home, None)
            if home:  # a part may have got no vectors
                yield compared(home, arrays(pa.Table.from_batches([rows])))
        if held:
            yield compared(arrays(pa.Table.from_batches(held)), None)

    return d.repartition("task").sortWithinPartitions("task", "task2", "guest").mapInArrow(run, "no long, links long, root long")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``CHUNK`` rows of one task that all are its own or all its guests, in order."""
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "task2", "guest")]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for k in range(a, b, CHUNK):
                yield batch.slice(k, min(CHUNK, b - k))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, vec_id = c.c AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
