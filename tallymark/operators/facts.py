"""Facts of an analysis as one row of JSON: shown points, statistics, patterns, coverage; and a lighter form of its points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.operators import patterns, stats
from tallymark.operators.execute import coverage, grouped, ordered
from tallymark.plans.spec import Spec
from tallymark.sources.scan import written

#: Chart kinds that are drawn as such; the others are bars.
LINES, SERIES = ("line", "area"), ("grouped_bar", "stacked_bar")


def chart_spec(spec: Spec) -> dict:
    """What a front end draws, without drawing it."""
    kind = spec.chart if spec.chart in LINES + SERIES else "bar"
    if len(spec.dimensions) == 2 and kind not in SERIES + LINES:
        kind = "grouped_bar"
    return {"kind": kind, "x": "dim0", "y": "value", "series": "dim1" if len(spec.dimensions) == 2 else None, "title": spec.title, "x_title": spec.dimensions[0].column, "y_title": spec.column}


def sampled_points(agg: DataFrame, most: int = 30) -> DataFrame:
    """At most ``most`` points in order: the first, the last, and every k-th between; all if they are few."""
    everything = W.partitionBy()
    d = agg.withColumn("n", F.count(F.lit(1)).over(everything)).withColumn("place", F.row_number().over(everything.orderBy("dim0")))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / (most - 2)))
    inner = (F.pmod(F.col("place") - 2, step) == 0) & (F.col("place") >= 2) & ((F.col("place") - 2) / step < most - 2)
    return d.where((F.col("n") <= most) | (F.col("place") == 1) | (F.col("place") == F.col("n")) | inner).select("dim0", "value", "place")


#: Groups of the first and of the second dimension that facts show, those with the largest values first; V5 bounds the first one before.
SHOWN = (50, 20)


def facts(df: DataFrame, spec: Spec, *, role: str | None = None, order: str | None = None, customer: str | None = None) -> DataFrame:
    """One row (title, n_groups, facts) for a validated spec; no row for fewer than two groups.

    The aggregate is written once, and points, statistics and patterns read that.
    """
    return of_aggregate(written(grouped(df, spec)), coverage(df, spec), spec, role=role, source=df, order=order, customer=customer)


def bounded(shown: DataFrame, temporal: bool) -> DataFrame:
    """Points of two dimensions, down to ``SHOWN`` groups of each: the largest by total, on a time axis the last.

    Each group kept is whole, and groups of one total are taken by name.
    """
    def kept(c: str, most: int, last: bool) -> DataFrame:
        d = shown.groupBy(c).agg(F.sum("value").alias("total"))
        return d.orderBy(F.desc(c) if last else F.desc("total"), c).limit(most).select(c)

    out = shown.join(F.broadcast(kept("dim0", SHOWN[0], temporal)), "dim0", "left_semi")
    return out.join(F.broadcast(kept("dim1", SHOWN[1], False)), "dim1", "left_semi").select(*shown.columns)


def of_aggregate(agg: DataFrame, cover: DataFrame, spec: Spec, *, role: str | None = None, source: DataFrame | None = None, order: str | None = None, customer: str | None = None) -> DataFrame:
    """``facts`` from a spec's aggregate and its row of coverage.

    ``n_groups`` counts all groups that the spec shows. Points are bounded by
    the spec's limit, which validation sets where a column has over 50 values,
    and with two dimensions by ``SHOWN``.
    """
    shown = ordered(agg, spec)
    dims = [c for c in shown.columns if c.startswith("dim")]
    some = shown if len(dims) == 1 else bounded(shown, spec.dimensions[0].type == "temporal")
    points = some.agg(F.array_sort(F.collect_list(F.struct(*dims, F.round("value", 2).alias("value"), "n_rows"))).alias("data_points"))
    points = shown.agg(F.count(F.lit(1)).alias("n_groups")).where("n_groups >= 2").crossJoin(points)  # one row each
    one = shown if len(dims) == 1 else agg.groupBy("dim0").agg(F.sum("value").alias("value"), F.sum("n_rows").alias("n_rows"))
    about = stats.trend(one) if spec.dimensions[0].type == "temporal" else stats.pareto(one)
    numbers = stats.basic(one).select(F.struct("*").alias("basic")).crossJoin(about.select(F.struct("*").alias("shape")))  # one row each
    seen = patterns.with_notes(patterns.detect(one, spec, role=role, source=source, order=order, customer=customer)).agg(F.array_sort(F.collect_list(F.struct("pattern_id", "confidence", "evidence", "causes", "actions"))).alias("detected_patterns"))
    d = points.crossJoin(numbers).crossJoin(seen).crossJoin(cover.select(F.struct("*").alias("coverage")))  # one row each
    body = F.to_json(F.struct(F.lit(spec.column).alias("measure"), F.lit(spec.aggregation).alias("aggregation"), F.lit(spec.chart).alias("chart"), "data_points", F.struct("basic", "shape").alias("computed_stats"), "detected_patterns", "coverage"))
    return d.select(F.lit(spec.title).alias("title"), "n_groups", body.alias("facts"))
