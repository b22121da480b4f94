"""Statistics and business patterns of an aggregate (dim0, value, n_rows).

Series over time are few rows and use one task's windows; what may run over as
many groups or rows as there are customers or orders does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

def _all():
    return W.partitionBy()


#: Points of a series, or groups, from which a trend or shares are told. Fixed value.
LEAST = 3


def basic(agg: DataFrame) -> DataFrame:
    d = agg.agg(F.count(F.lit(1)).alias("n_points"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"))
    return d.select("n_points", "total", "mean", exact_median(agg, "value").scalar().alias("median"), "max", "min")


def marked_edges(agg: DataFrame) -> DataFrame:
    """Adds place, n and partial: a first or last period with under half of the inner median, by value or rows, of at least four."""
    order = _all().orderBy("dim0")
    d = agg.withColumn("place", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(_all()))
    inner = (F.col("place") > 1) & (F.col("place") < F.col("n"))
    d = d.withColumn("mid_value", F.median(F.when(inner, F.col("value"))).over(_all())).withColumn("mid_rows", F.median(F.when(inner, F.col("n_rows"))).over(_all()))
    low = (F.col("value") < 0.5 * F.col("mid_value")) | (F.col("n_rows") < 0.5 * F.col("mid_rows"))
    return d.withColumn("partial", (F.col("n") >= 4) & ~inner & low)


def trend(agg: DataFrame) -> DataFrame:
    """first, last, change, slope, r2, volatility and direction over whole periods, or all if under two are left.

    A series of under three points has none of these, and one with under three
    whole periods no slope, r2, volatility and direction: they are null.
    """
    d = marked_edges(agg).withColumnRenamed("n", "n_all").withColumn("whole", F.count_if(~F.col("partial")).over(_all())).where(~F.col("partial") | (F.col("whole") < 2))
    d = d.withColumn("x", (F.row_number().over(_all().orderBy("dim0")) - 1).cast("double"))
    ends = F.max("n_all") >= LEAST
    line = ends & (F.count(F.lit(1)) >= LEAST)
    out = d.agg(
        F.count(F.lit(1)).alias("n"), F.when(ends, F.min_by("value", "x")).alias("first_value"), F.when(ends, F.max_by("value", "x")).alias("last_value"),
        F.when(line, F.regr_slope("value", "x")).alias("slope"), F.when(line, F.when(F.var_pop("value") == 0, 0.0).otherwise(F.regr_r2("value", "x"))).alias("r2"),
        F.avg("value").alias("mean"), F.when(line, F.stddev_samp("value")).alias("sd"),
    )
    out = out.withColumn("change_pct", (F.col("last_value") - F.col("first_value")) / F.nullif(F.abs("first_value"), F.lit(0.0)) * 100)
    size = F.when(F.col("mean") == 0, 1.0).otherwise(F.abs("mean"))
    out = out.withColumn("change_absolute", F.col("last_value") - F.col("first_value"))
    return out.withColumn("volatility_pct", F.col("sd") / size * 100).withColumn("direction", F.when(F.col("slope").isNotNull(), direction(size))).drop("sd")


def direction(size: Column) -> Column:
    flat = (F.col("r2") < 0.25) | (F.abs("slope") / size * 100 < 1.0) | (F.coalesce(F.signum("change_pct"), F.lit(0.0)) * F.signum("slope") < 0)
    return F.when(flat, "stable").when(F.col("slope") > 0, "hausse").otherwise("baisse")


def magnitude(c: Column, steps: int) -> Column:
    """A whole number that never falls as ``c`` rises, ``steps`` to a doubling: at most some hundred thousand of them."""
    return (F.signum(c) * F.floor(F.log2(F.abs(c) + 1) * steps)).cast("long")


def running(values: DataFrame) -> DataFrame:
    """Adds to (value, k) of distinct values: k0 and s0, the rows and the sum of all larger values, n and total.

    Sums run within a class of magnitude, a fraction of a per cent wide, on top
    of those of the classes above it. Equal values are one row, so a class holds
    as many rows as there are different values in its range.
    """
    d = values.withColumn("class", magnitude(F.col("value"), 1024))
    above = _all().orderBy(F.desc("class")).rowsBetween(W.unboundedPreceding, -1)  # one row a class
    sums = d.groupBy("class").agg(F.sum("k").alias("k"), F.sum(F.col("value") * F.col("k")).alias("s"))
    sums = sums.select("class", F.coalesce(F.sum("k").over(above), F.lit(0)).alias("ck"), F.coalesce(F.sum("s").over(above), F.lit(0.0)).alias("cs"), F.sum("k").over(_all()).alias("n"), F.sum("s").over(_all()).alias("total"))
    within = W.partitionBy("class").orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, -1)
    over = lambda x: F.coalesce(F.sum(x).over(within), F.lit(0))
    d = d.join(sums, "class")
    return d.select("value", "k", (F.col("ck") + over(F.col("k"))).alias("k0"), (F.col("cs") + over(F.col("value") * F.col("k"))).alias("s0"), "n", "total")


def pareto(agg: DataFrame) -> DataFrame:
    """Shares of the largest fifth and of the largest group, and how many groups hold 80 %.

    All but the number of groups are null for under three groups or a total of
    0. Groups may be as many as customers and all alike: equal values are one
    row with a count. Against a negative total shares have its sign.
    """
    values = agg.where("value IS NOT NULL").groupBy(F.col("value").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("k"))
    d = running(values).withColumn("u", F.try_divide("value", "total")).withColumn("c0", F.try_divide("s0", "total"))
    top = F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))
    in_top = F.greatest(F.lit(0), F.least(F.col("k"), top - F.col("k0")))
    # Of k equal values the j-th brings the running sum to s0 + j * value: those at 80 % or below, corrected for the quotient's rounding.
    under = lambda j: F.try_divide(F.col("s0") + j * F.col("value"), F.col("total")) <= 0.8
    guess = F.greatest(F.lit(0.0), F.least(F.try_divide(0.8 - F.col("c0"), F.col("u")), F.col("k").cast("double")))
    low, high = F.floor(guess), F.ceil(guess)
    rising = F.when((high <= F.col("k")) & under(high), high).when(under(low), low).otherwise(low - 1)
    falling = F.col("k") - F.when(under(F.greatest(low, F.lit(1))), F.greatest(low, F.lit(1))).when(under(F.greatest(high, F.lit(1))), F.greatest(high, F.lit(1))).otherwise(high + 1) + 1
    held = F.when(F.col("u") > 0, rising).when(F.col("u") < 0, falling).otherwise(F.when(under(F.lit(0)), F.col("k")).otherwise(0))
    out = d.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_groups"), F.max("total").alias("total"), (F.sum(in_top * F.col("u")) * 100).alias("top20_share_pct"), (F.max_by("u", "value") * 100).alias("top1_share_pct"), (F.sum(F.greatest(F.lit(0), held)) + 1).cast("long").alias("n_for_80pct"))
    told = (F.col("n_groups") >= LEAST) & (F.col("total") != 0)
    return out.select("n_groups", *[F.when(told, F.col(c)).alias(c) for c in ("top20_share_pct", "top1_share_pct", "n_for_80pct")])


def exact_median(df: DataFrame, c: str) -> DataFrame:
    """One row with the median m, null for no values; nulls and NaN don't count."""
    return _medians(df, [], c)


def exact_medians(df: DataFrame, keys: list[str], c: str, weight: str | None = None) -> DataFrame:
    """(keys, m): the median of each group that has values; null keys are a group. A row stands for ``weight`` equal ones."""
    return _medians(df, keys, c, weight)


def _medians(df: DataFrame, keys: list[str], c: str, weight: str | None = None) -> DataFrame:
    """Values are counted by magnitude, and only those of the classes that hold the middle are ordered, each once with its count: no task sees more than the distinct values of such a class of a group."""
    d = df.select(*keys, F.col(c).cast("double").alias("__v"), (F.col(weight) if weight else F.lit(1)).alias("__w")).where("__v IS NOT NULL AND NOT isnan(__v)").withColumn("__class", magnitude(F.col("__v"), 128 if keys else 1024))
    group = W.partitionBy(*keys)
    sizes = d.groupBy(*keys, "__class").agg(F.sum("__w").alias("__k"))
    below = group.orderBy("__class").rowsBetween(W.unboundedPreceding, -1)  # a row for each class of magnitude of a group
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__k").over(below), F.lit(0))).withColumn("__n", F.sum("__k").over(group))
    sizes = sizes.withColumn("__lo", F.floor((F.col("__n") - 1) / 2)).withColumn("__hi", F.floor(F.col("__n") / 2)).where("__base <= __hi AND __base + __k > __lo")
    middle = sizes.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.col("__class").alias("__c"), "__base", "__lo", "__hi")  # two classes of a group at most
    on = F.col("__class") == F.col("__c")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__{i}"))
    held = d.join(middle if keys else F.broadcast(middle), on).groupBy(*keys, "__base", "__lo", "__hi", "__v").agg(F.sum("__w").alias("__k"))
    at = F.col("__base") + F.coalesce(F.sum("__k").over(W.partitionBy(*keys, "__base").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("__at", at).where("__at <= __hi AND __at + __k > __lo")
    m = ((F.min("__v") + F.max("__v")) / 2).alias("m")
    return held.groupBy(*keys).agg(m) if keys else held.agg(m)


def with_robust_z(df: DataFrame, c: str = "value") -> DataFrame:
    """Adds med, mad and z; z is null where half of all values are equal."""
    d = df.withColumn("med", exact_median(df, c).scalar())
    off = d.select(F.abs(F.col(c) - F.col("med")).alias("off"))
    d = d.withColumn("mad", exact_median(off, "off").scalar())
    return d.withColumn("z", F.lit(0.6745) * F.abs(F.col(c) - F.col("med")) / F.nullif("mad", F.lit(0.0)))


def extremes(agg: DataFrame) -> DataFrame:
    """max_period and min_period: the first groups with the largest and the smallest value."""
    d = agg.withColumn("__top", agg.agg(F.max("value")).scalar()).withColumn("__low", agg.agg(F.min("value")).scalar())
    return d.agg(F.min(F.when(F.col("value") == F.col("__top"), F.col("dim0"))).alias("max_period"), F.min(F.when(F.col("value") == F.col("__low"), F.col("dim0"))).alias("min_period"))


def spikes(agg: DataFrame) -> DataFrame:
    return with_robust_z(agg).where("z > 3.5 AND value > med").select("dim0", "value", "z")


def long_tail(agg: DataFrame) -> DataFrame:
    """Groups, and those with under 1 % of the total (none if it is 0); found if these are three or more and 30 %."""
    d = agg.withColumn("share", F.try_divide(F.col("value"), agg.agg(F.sum("value")).scalar()))
    d = d.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("share") < 0.01).alias("n_small"))
    return d.withColumn("found", (F.col("n_groups") >= 4) & (F.col("n_small") >= F.greatest(F.lit(3.0), 0.3 * F.col("n_groups"))))


def peaks(agg: DataFrame, factor: float, of: str, least: int) -> DataFrame:
    """Groups at ``factor`` times the mean or median of at least ``least`` groups."""
    mid = F.avg("value") if of == "mean" else F.median("value")
    d = agg.withColumn("mid", mid.over(_all())).withColumn("n", F.count(F.lit(1)).over(_all()))
    return d.where((F.col("n") >= least) & (F.col("value") >= factor * F.col("mid"))).select("dim0", "value")


def trend_pattern(agg: DataFrame) -> DataFrame:
    """trend_decline or trend_growth with its confidence, if either is found."""
    t = trend(agg).where("n >= 4 AND r2 > 0.25 AND direction <> 'stable' AND abs(slope) > 0.02 * mean")
    return t.select(F.when(F.col("direction") == "baisse", "trend_decline").otherwise("trend_growth").alias("pattern_id"), F.least(F.lit(0.95), F.col("r2") + 0.3).alias("confidence"))
