"""Lloyd's clustering of integer vectors, each distinct vector once with its multiplicity.

Components are turned to integers, equal vectors become one row with a count
(counted within a task before they are sent), and every round assigns the
distinct vectors and adds them up, times their counts, as integers. Tasks
return one sum for each centroid and component, so a round moves a number of
rows that doesn't grow with the vectors. Assignments are joined back to the
ids by vector; the few vectors that hold a large share of all rows are joined
by broadcast, so no task gets all rows of one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import dropped, small_batches, stored, table

DIM = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: A vector with more than this share of all rows is joined by broadcast; there can't be more than one over the share of them.
HEAVY_SHARE = 1 / 256
#: Integers up to here: squared distances of 64 components, and sums over 2**36 rows, then fit 64 bits.
MOST = 1 << 27


def quantised(vectors: DataFrame, *, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q, h) of vectors with ``dim`` components, none null or non-finite: floor(scale * component), and a hash.

    Raises if an integer is beyond ``MOST``, where distances would no longer fit a long.
    """
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    plain = (F.size("v") == dim) & F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    big = F.raise_error(F.concat(F.lit(f"a component times {scale} is beyond {MOST}: "), F.col("vec_id").cast("string")))
    whole = lambda x: F.when(F.abs(x * scale) < MOST, F.floor(x * scale).cast("int")).otherwise(big.cast("int"))
    return d.where(plain).select("vec_id", F.transform("v", whole).alias("q")).withColumn("h", F.xxhash64("q"))


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids, behind the seed, have the smallest SHA-256; null ids come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(key.alias("key"), "q").orderBy(F.asc_nulls_last("key"), "q").limit(k).collect()
    return np.array([r.q for r in first], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance), exactly; the smaller number if several are as near. ``most`` bounds all magnitudes."""
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:  # doubles hold these integers
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    near = d.argmin(1)
    return near, d[np.arange(len(x)), near].astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _moved(classes: DataFrame, centroids: np.ndarray, most: int) -> np.ndarray:
    """Centroids after one round: floor(sum / count) over the vectors nearest to each; those without any stay."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x, n = _matrix(batch.column("q"), dim), batch.column("n").to_numpy()
            near, _ = nearest(x, centroids, most)
            rows = np.concatenate([x * n[:, None], n[:, None]], 1)
            for c in np.unique(near).tolist():
                sums[c] += rows[near == c].sum(0)
        slots = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sums.ravel()[slots])], ["slot", "s"])

    got = classes.select("q", "n").mapInArrow(run, "slot long, s long").groupBy("slot").agg(F.sum("s").alias("s")).toArrow()
    sums = np.zeros(k * (dim + 1), np.int64)
    sums[got.column("slot").to_numpy()] = got.column("s").to_numpy()
    sums = sums.reshape(k, dim + 1)
    out = centroids.copy()
    some = sums[:, dim] > 0
    out[some] = sums[some, :dim] // sums[some, dim:]
    return out


def _assigned(classes: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, d = nearest(_matrix(batch.column("q"), centroids.shape[1]), centroids, most)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("h"), batch.column("n"), pa.array(near.astype(np.int32)), pa.array(d)], ["q", "h", "n", "cluster", "distance"])

    return classes.mapInArrow(run, "q array<int>, h long, n long, cluster int, distance long")


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """One row per vector (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), and the centroids.

    Vectors that are null, have another number of components, or null or
    non-finite ones, are left out. Repeated rows count as often as they occur,
    and rows of one id may lie in different clusters; a null id starts no
    centroid while others are left. Fewer vectors than ``clusters`` give as
    many centroids as vectors. An empty table gives no rows. Ties go to the
    smaller number. Components beyond 2**27 after scaling raise an error, as
    distances wouldn't fit a long. Other columns aren't read. Sets the
    session's Arrow batch size.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = quantised(vectors, dim=dim, scale=scale, id_col=id_col, vector_col=vector_col)
    classes = stored(rows.groupBy("h", "q").agg(F.count(F.lit(1)).alias("n")).select("q", "h", "n"), "kmeans-vectors")
    total, most = classes.agg(F.sum("n"), F.max(F.greatest(F.array_max("q"), -F.array_min("q")))).first()
    centroids = seeds(rows, clusters, seed).reshape(-1, dim)
    if not total:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), centroids
    for _ in range(rounds):
        centroids = _moved(classes, centroids, most)
    last = stored(_assigned(classes, centroids, most), "kmeans-assigned")
    dropped(classes)
    per_cluster = {r.cluster: r.s for r in last.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("n")).alias("s")).collect()}
    by_cluster = spark.createDataFrame([(c, s, sum(per_cluster.values()), _digest(centroids[c])) for c, s in sorted(per_cluster.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = _by_id(rows, last, total).join(F.broadcast(by_cluster), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def _by_id(rows: DataFrame, last: DataFrame, total: int) -> DataFrame:
    """Assignments of rows: of the vectors with a large share of them by broadcast, of all others by a shuffle."""
    heavy: Column = F.col("n") > total * HEAVY_SHARE
    few = F.broadcast(last.where(heavy).select("h", "q", "cluster", "distance"))
    common = rows.join(few, ["h", "q"])
    others = rows.join(F.broadcast(few.select("h", "q")), ["h", "q"], "left_anti").join(last.where(~heavy).select("h", "q", "cluster", "distance"), ["h", "q"])
    return common.unionByName(others)


def op12_weighted_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))[0]


def _sql() -> str:
    """Ten rounds, written out one after the other."""
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT q, n, min(d * {CLUSTERS} + k) AS dk FROM (SELECT d.q, d.n, c.k, list_sum(list_transform(list_zip(d.q, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM d CROSS JOIN c{r} c) GROUP BY q, n)"
    text = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS MATERIALIZED (SELECT q, count(*) AS n FROM kept GROUP BY q),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s, q) - 1 AS k, q AS c FROM (SELECT q, sha256('{SEED}:' || vec_id) AS s FROM kept ORDER BY s, q LIMIT {CLUSTERS}))"""
    for r in range(ROUNDS):
        text += f""",
{near(r)},
s{r} AS (SELECT dk % {CLUSTERS} AS k, i, sum(n * q[i]) AS s, sum(n) AS n FROM a{r} CROSS JOIN range(1, {DIM + 1}) t(i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY k) m ON m.k = c.k)"""
    return text + f""",
{near(ROUNDS)},
l AS (SELECT q, n, dk % {CLUSTERS} AS k, dk // {CLUSTERS} AS distance FROM a{ROUNDS}),
i AS (SELECT k, sum(distance * n)::BIGINT AS cluster_inertia FROM l GROUP BY k)
SELECT vec_id, l.k::INTEGER AS cluster, distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM i)::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM kept JOIN l ON l.q = kept.q JOIN i ON i.k = l.k JOIN c{ROUNDS} c ON c.k = l.k
"""


SQL = _sql()
