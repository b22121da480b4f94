"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document's expected copies are
its source's target over its source's words. Within a source the expected
copies are summed along an order, one random offset is added, and a document
is emitted once for each integer that the running sum crosses. Only
DataFrame functions run here.

The order within a source is (size class, slice of the document's hash, size,
document). Classes are ranges of sizes, each at most a thirty-second wide, so
sizes rise along the order but for that: the words taken then lie within one
largest document of the target, and a thirty-second of a document for each
slice. The slices let a source or a size that holds most rows be numbered by
many tasks. A slice holds about 1/4096 of all rows at any input size, so the
table of slices has a bounded number of rows for each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.llm.common import n_words, stored

#: Weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20240601
SLICES = 4096


def _uniform(*parts) -> F.Column:
    """A number from 0 up to 1 that only depends on its text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(per_source: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources in code-point order (null last) share all words by weight; none
    passes ``cap`` times its own words, and what is over goes to the others by
    weight until none is above. Taken by rising ``cap * size / weight``, the
    capped sources are those whose own cap lies below what the rest would get.
    The table holds a row for each source, so its windows use one task.
    """
    one = W.partitionBy()
    by_name = one.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    d = per_source.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", w.cast("long"))
    d = d.withColumn("limit", F.col("source_size") * cap).withColumn("fill", F.col("limit") / F.col("w"))
    order = one.orderBy("fill", "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    d = d.withColumn("left_words", F.sum("source_size").over(one) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    d = d.withColumn("left_w", F.sum("w").over(after))
    d = d.withColumn("capped", F.col("limit") * F.col("left_w") <= F.col("left_words") * F.col("w"))
    d = d.withColumn("first_open", F.min(F.when(~F.col("capped"), F.struct("fill", "rank", "left_words", "left_w"))).over(one))
    open_ = F.col("first_open").isNotNull() & (F.struct("fill", "rank") >= F.struct("first_open.fill", "first_open.rank"))
    share = (F.col("first_open.left_words") * F.col("w")).cast("double") / F.col("first_open.left_w").cast("double")
    return d.select("source", "source_size", F.when(open_, share).otherwise(F.col("limit").cast("double")).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: size, its source's size and target, copies and words taken.

    Null or empty texts have size 0; they take no words but keep a number of
    copies like any other document of their source. A source without words
    has target 0. A null source is one source, ordered last. Rows with equal
    ids count as documents of their own; rows with null ids are told apart by
    their texts. An empty table gives an empty table. Texts are read whole.
    Columns other than the three named are not read.
    """
    place = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.xxhash64(text_col).cast("string")))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), place.alias("place"))
    # 32 classes between powers of two.
    d = d.withColumn("bits", F.length(F.bin("size"))).withColumn("class", F.expr("bits * 32 + shiftright(size * 64, bits) - 32").cast("long")).drop("bits")
    d = stored(d, "mix-sizes")
    strata = d.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    targets = source_targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    strata = strata.withColumn("slices", F.ceil(F.col("n") * SLICES / F.sum("n").over(W.partitionBy()))).drop("words")
    known = strata.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.class", "slices", "source_size", "target")
    known = stored(known, "mix-strata")
    # Few rows: one for each source and size class. Larger tables are joined by a shuffle whose hot keys AQE splits.
    if known.count() <= 100_000:
        known = F.broadcast(known)
    on = F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d.class") == F.col("k.class"))
    d = d.alias("d").join(known.alias("k"), on).select("d.doc_id", "d.source", "d.class", "size", "place", "slices", "source_size", "target")
    d = d.withColumn("slice", F.floor(_uniform(F.lit("slice"), F.col("place")) * F.col("slices")))
    block = ["source", "class", "slice"]
    counts = d.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("source").orderBy("class", "slice").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # At most 4096 slices and one for each source and class.
    bases = stored(bases, "mix-bases")
    if bases.count() <= 100_000 + SLICES:
        bases = F.broadcast(bases)
    here = F.row_number().over(W.partitionBy(*block).orderBy("size", "doc_id", "place"))
    d = d.withColumn("here", here)
    on = F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.class") == F.col("b.class")) & (F.col("d.slice") == F.col("b.slice"))
    d = d.alias("d").join(bases.alias("b"), on).select("d.doc_id", "d.source", "size", "source_size", "target", (F.col("base") + F.col("here")).alias("at"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _uniform(F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none")))
    d = d.withColumn("rate", rate).withColumn("offset", offset)
    copies = F.floor(F.col("at") * F.col("rate") + F.col("offset")) - F.floor((F.col("at") - 1) * F.col("rate") + F.col("offset"))
    d = d.withColumn("copies", F.least(copies, F.lit(cap)).cast("long"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns they came with.

    Rows with equal ids are told apart by a hash of the row's text and source;
    rows equal in all three take the same number of copies each as one of them.
    Columns of any name are carried as they are; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(row.alias("row"), F.struct(F.col("doc_id"), F.xxhash64("text", "source")).alias("k"))
    taken = mix(named.select(F.col("k").alias("doc_id"), "row.text", "row.source"), **options)
    taken = taken.groupBy(F.col("doc_id").alias("taken_k")).agg(F.max("copies").cast("int").alias("copies"))
    joined = named.join(taken, F.col("k").eqNullSafe(F.col("taken_k"))).where("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    from tallymark.llm.common import table

    return mix(table(spark, sf_dir, "documents")).drop("copies", "source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
c AS (SELECT *, bits * 32 + ((size::BIGINT * 64) >> bits) - 32 AS class FROM (SELECT *, length(format('{:b}', size::BIGINT)) AS bits FROM d)),
st AS (SELECT source, class, count(*) AS n, ceil(count(*) * 4096 / sum(count(*)) OVER ()) AS slices FROM c GROUP BY source, class),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM c GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM r),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
  sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM w),
o AS (SELECT *, min(CASE WHEN cap * left_w > left_words * w THEN {'f': cap / w, 'rank': rank, 'words': left_words, 'w': left_w} END) OVER () AS first_open FROM f),
t AS (SELECT source, source_size, CASE WHEN first_open IS NOT NULL AND (cap / w > first_open.f OR (cap / w = first_open.f AND rank >= first_open.rank))
  THEN (first_open.words * w)::DOUBLE / first_open.w::DOUBLE ELSE cap::DOUBLE END AS target FROM o),
u AS (SELECT c.*, source_size, target, floor(('0x' || substr(md5('slice:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * slices) AS slice
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source JOIN st ON c.source IS NOT DISTINCT FROM st.source AND c.class = st.class),
a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slice, size, doc_id) AS pos,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('20240601:' || coalesce('s' || source, 'none')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM u)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (least(floor(pos * rate + off) - floor((pos - 1) * rate + off), 3) * size)::BIGINT AS taken FROM a
"""
