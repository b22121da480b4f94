"""Runs an analysis spec as one DataFrame plan: filters, keys, aggregate, sort, limit.

Everything up to the aggregate is a narrow projection, so filters and column
pruning reach the scan and the only shuffle is the partial aggregate's. Null
keys are left out and counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.stats import exact_medians
from tallymark.plans.spec import Dimension, Filter, Spec

# Monday first.
WEEKDAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")


def predicate(df: DataFrame, f: Filter) -> Column | None:
    """The filter as a condition that is never null, or None if its column or operation is unknown.

    Equality is of text, but for numeric columns of numbers; order is of numbers.
    """
    if f.column not in df.columns:
        return None
    numeric = isinstance(df.schema[f.column].dataType, T.NumericType)
    c = F.col(f.column) if numeric else F.col(f.column).cast("string")
    number = F.col(f.column).cast("double") if numeric else F.col(f.column).cast("string").try_cast("double")
    one = (lambda v: F.lit(float(v))) if numeric else (lambda v: F.lit(str(v)))
    try:
        found = {
            "eq": lambda: c == one(f.value),
            "neq": lambda: ~c.eqNullSafe(one(f.value)),
            "in": lambda: c.isin(*[one(v) for v in f.value]),
            "not_in": lambda: c.isNull() | ~c.isin(*[one(v) for v in f.value]),
            "gt": lambda: number > float(f.value),
            "gte": lambda: number >= float(f.value),
            "lt": lambda: number < float(f.value),
            "lte": lambda: number <= float(f.value),
            "between": lambda: number.between(float(f.value[0]), float(f.value[1])),
            "not_null": lambda: F.col(f.column).isNotNull(),
        }.get(f.op, lambda: None)()
    except (TypeError, ValueError):
        return None
    return found


def filtered(df: DataFrame, filters: tuple[Filter, ...]) -> tuple[DataFrame, list[Filter]]:
    """Rows that meet all filters, and the filters that could be applied."""
    used = [(f, p) for f in filters if (p := predicate(df, f)) is not None]
    return reduce(lambda d, x: d.where(x[1]), used, df), [f for f, _ in used]


def time_key(c: Column, grain: str) -> Column:
    return {
        "day": lambda: F.date_format(c, "yyyy-MM-dd"),
        "week": lambda: F.date_format(F.date_trunc("week", c), "yyyy-MM-dd"),
        "month": lambda: F.date_format(c, "yyyy-MM"),
        "quarter": lambda: F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string")),
        "year": lambda: F.year(c).cast("string"),
        "dayofweek": lambda: F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(c) + 1),
        "hour": lambda: F.concat(F.lpad(F.hour(c).cast("string"), 2, "0"), F.lit("h")),
    }[grain]()


def key(d: Dimension) -> Column:
    if d.type == "temporal":
        return time_key(F.col(d.column), d.grain or "month")
    return F.col(d.column).cast("string")


def binned(df: DataFrame, d: Dimension) -> DataFrame:
    """Replaces a number by its equal-width bin, named by its bounds' numbers."""
    lo, hi = df.agg(F.min(d.column), F.max(d.column)).first()
    if lo is None or lo == hi:
        return df
    return df.withColumn(d.column, _bin(d, float(lo), float(hi)))


def _bin(d: Dimension, lo: float, hi: float) -> Column:
    """The number of the bin of a value, the largest one in the last; null for none."""
    x = F.col(d.column).cast("double")
    return F.when(x.isNotNull(), F.least(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(d.bins)), F.lit(d.bins)))


def aggregate(c: Column, how: str) -> Column:
    """The spec's aggregate but for the median; a sum of nulls alone is 0, and the other kinds are null there."""
    return {
        "sum": lambda: F.coalesce(F.sum(c.cast("double")), F.lit(0.0)),
        "mean": lambda: F.avg(c),
        "count": lambda: F.count(c).cast("double"),
        "count_distinct": lambda: F.count_distinct(c).cast("double"),
        "min": lambda: F.min(c).cast("double"),
        "max": lambda: F.max(c).cast("double"),
        "std": lambda: F.stddev_samp(c),
    }[how]()


def grouped(df: DataFrame, spec: Spec) -> DataFrame:
    """dim0 [, dim1], value, n_rows of all groups that have a value."""
    df, _ = filtered(df, spec.filters)
    for d in spec.dimensions:
        if d.type == "numeric_binned":
            df = binned(df, d)
    keys = [key(d).alias(f"dim{k}") for k, d in enumerate(spec.dimensions)]
    names = [f"dim{k}" for k in range(len(keys))]
    rows = df.select(*keys, F.col(spec.column).alias("x")).dropna(subset=names)
    if spec.aggregation == "median":  # a group may hold a third of all rows
        sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"))
        return exact_medians(rows, names, "x").join(sizes, names).select(*names, F.col("m").alias("value"), "n_rows")
    out = rows.groupBy(*names).agg(aggregate(F.col("x"), spec.aggregation).alias("value"), F.count(F.lit(1)).alias("n_rows"))
    return out.where("value IS NOT NULL")


#: Aggregates that need the values of a group, counted by distinct value; all others add up as they are.
BY_VALUE = ("median", "count_distinct")
KEYS = ("spec", "dim0", "dim1")


def _expanded(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """A row (spec, dim0, dim1, x, v, no_key) for each spec that a row's filters let through; spec -1 for every row."""
    bins = {(x.column, x.bins, s.filters): x for s in specs for x in s.dimensions if x.type == "numeric_binned"}
    ranges = {}
    if bins:  # one pass over the binned columns
        ends = [F.struct(F.min(F.when(_kept(df, f), F.col(c).cast("double"))).alias("lo"), F.max(F.when(_kept(df, f), F.col(c).cast("double"))).alias("hi")) for c, _, f in bins]
        ranges = dict(zip(bins, df.agg(*ends).first(), strict=True))
    none = F.lit(None).cast("string")

    def dim(s: Spec, d: Dimension) -> Column:
        lo, hi = ranges.get((d.column, d.bins, s.filters), (None, None))
        if lo is None or lo == hi:
            return key(d)
        return _bin(d, lo, hi).cast("string")

    cells = []
    for k, s in enumerate(specs):
        dims = [dim(s, d) for d in s.dimensions]
        missing = reduce(lambda a, b: a | b, [c.isNull() for c in dims])
        first, second = [F.when(~missing, c) for c in dims] + [none] * (2 - len(dims))
        x = F.lit(None).cast("double") if s.aggregation in ("count", "count_distinct") else F.col(s.column).cast("double")
        v = F.col(s.column).cast("string") if s.aggregation == "count_distinct" else x.cast("string") if s.aggregation == "median" else none
        here = F.struct(F.lit(k).alias("spec"), first.alias("dim0"), second.alias("dim1"), x.alias("x"), F.when(~missing, v).alias("v"), F.col(s.column).isNotNull().alias("there"), missing.alias("no_key"))
        cells.append(F.when(_kept(df, s.filters), here))
    everything = F.struct(F.lit(-1).alias("spec"), none.alias("dim0"), none.alias("dim1"), F.lit(None).cast("double").alias("x"), none.alias("v"), F.lit(False).alias("there"), F.lit(False).alias("no_key"))
    return df.select(F.explode(F.array(everything, *cells)).alias("e")).where("e IS NOT NULL").select("e.*")


def _kept(df: DataFrame, filters: tuple[Filter, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for f in filters if (p := predicate(df, f)) is not None], F.lit(True))


def aggregated(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """Partial results of several specs from one scan and one shuffle; ``of_spec`` and ``coverage_of`` read them.

    Every row counts for each spec that its filters let through, added up by
    (spec, keys) within its task before it is sent. For medians and distinct
    counts the value is one more key, so that no task gets all values of a group.
    """
    d = _expanded(df, specs).groupBy(*KEYS, "v", "no_key")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("there").alias("n_there"), F.sum("x").alias("sum"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.stddev_samp("x").alias("std"))


def of_spec(parts: DataFrame, specs: list[Spec], k: int) -> DataFrame:
    """What ``grouped`` gives for the k-th spec, from the results of all."""
    s = specs[k]
    names = ["dim0", "dim1"][: len(s.dimensions)]
    d = parts.where((F.col("spec") == k) & ~F.col("no_key"))
    if s.aggregation == "median":
        sizes = d.groupBy(*names).agg(F.sum("n_rows").alias("n_rows"))
        middle = exact_medians(d.withColumn("v", F.col("v").cast("double")), names, "v", weight="n_rows")
        return middle.join(sizes, names).select(*names, F.col("m").alias("value"), "n_rows")
    if s.aggregation == "count_distinct":
        return d.groupBy(*names).agg(F.count("v").cast("double").alias("value"), F.sum("n_rows").alias("n_rows"))
    value = {"sum": F.coalesce(F.col("sum"), F.lit(0.0)), "count": F.col("n_there").cast("double")}.get(s.aggregation, F.col(s.aggregation))
    return d.select(*names, value.alias("value"), "n_rows").where("value IS NOT NULL")


def coverage_of(parts: DataFrame, k: int) -> DataFrame:
    """What ``coverage`` gives for the k-th spec, from the results of all."""
    own = F.col("spec") == k
    n = lambda which: F.coalesce(F.sum(F.when(which, F.col("n_rows"))), F.lit(0)).cast("long")
    return parts.where((F.col("spec") == -1) | own).agg(n(F.col("spec") == -1).alias("n_rows"), n(own).alias("n_filtered"), n(own & F.col("no_key")).alias("n_rows_excluded"))


def execute(df: DataFrame, spec: Spec) -> DataFrame:
    """The groups that are shown, in order.

    Time sorted by dimension always rises. A limit keeps the largest or
    smallest values, or on a time axis the last groups. Ties go by key.
    """
    return ordered(grouped(df, spec), spec)


def ordered(out: DataFrame, spec: Spec) -> DataFrame:
    """The shown groups of an aggregate."""
    temporal = spec.dimensions[0].type == "temporal"
    dims = [c for c in out.columns if c.startswith("dim")]
    by_measure = spec.sort_by == "measure" or spec.sort_by is None and not temporal
    down = bool(spec.descending) if spec.descending is not None else by_measure
    value = [F.desc("value") if down else F.asc("value"), *dims]
    if spec.limit:
        out = out.orderBy(*([F.desc("dim0")] if temporal and not by_measure else value)).limit(spec.limit)
    return out.orderBy(*(value if by_measure else [F.asc("dim0") if temporal or not down else F.desc("dim0"), *dims[1:]]))


def present_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Those of some filter values, as text, that occur in a column."""
    wanted = df.sparkSession.createDataFrame([(str(v),) for v in values], "value string")
    return wanted.join(df.select(F.col(f"`{column}`").cast("string").alias("value")), "value", "left_semi")


def with_totals(df: DataFrame, spec: Spec) -> DataFrame:
    """The shown groups with the number and the total of all groups before the limit, if the spec has one."""
    out = grouped(df, spec)
    both = out.agg(F.struct(F.count(F.lit(1)).alias("n_groups"), F.sum("value").alias("total"))).scalar()
    out = out.withColumn("all", both).select(*out.columns, "all.n_groups", "all.total").orderBy(F.desc("value") if spec.descending else F.asc("value"), "dim0")
    return out.limit(spec.limit) if spec.limit else out


def coverage(df: DataFrame, spec: Spec) -> DataFrame:
    """Rows in, rows left by the filters, and of these without a key."""
    ok = reduce(lambda a, b: a & b, [key(d).isNotNull() for d in spec.dimensions])
    keep = reduce(lambda a, b: a & b, [p for f in spec.filters if (p := predicate(df, f)) is not None], F.lit(True))
    keep = F.coalesce(keep, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(keep).alias("n_filtered"), F.count_if(keep & ~ok).alias("n_rows_excluded"))
