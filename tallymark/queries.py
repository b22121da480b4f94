"""Queries of the sales engine by name, and the SQL that gives the same rows.

Doubles that are sums over many rows are rounded far below a cent in both, as
the order of addition is not fixed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import facts, patterns, report, stats
from tallymark.operators.execute import WEEKDAYS, aggregated, coverage, coverage_of, execute, filtered, grouped, with_totals
from tallymark.plans.spec import Dimension, Filter, Spec, guaranteed
from tallymark.sources import sales as S
from tallymark.sources.scan import view, written

QUERIES: dict = {}
ORACLE_SQL: dict = {}

MONTH = Dimension("o_orderdate", "temporal", "month")
STATUS = Dimension("o_orderstatus")
PRIORITY = Dimension("o_orderpriority")
ORDERS = "orders"


def _put(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _round(df, *names, digits: int = 4):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


_AGG = {
    "sum": "coalesce(sum({c}), 0)", "mean": "avg({c})", "median": "median({c})", "count": "count({c})::DOUBLE", "count_distinct": "count(DISTINCT {c})::DOUBLE",
    "min": "min({c})::DOUBLE", "max": "max({c})::DOUBLE", "std": "stddev_samp({c})",
}
_DAYS = "[" + ", ".join(f"'{x}'" for x in WEEKDAYS) + "]"
_KEY = {
    "day": "strftime({c}, '%Y-%m-%d')", "week": "strftime(date_trunc('week', {c}), '%Y-%m-%d')", "month": "strftime({c}, '%Y-%m')",
    "quarter": "year({c})::VARCHAR || 'Q' || quarter({c})::VARCHAR", "year": "year({c})::VARCHAR", "dayofweek": _DAYS + "[isodow({c})]", "hour": "strftime({c}, '%H') || 'h'",
}


def _sql(spec: Spec, source: str, where: str = "true", tail: str = "") -> str:
    keys = [(_KEY[d.grain] if d.type == "temporal" else "{c}::VARCHAR").format(c=d.column) for d in spec.dimensions]
    dims = ", ".join(f"{k} AS dim{i}" for i, k in enumerate(keys))
    names = ", ".join(f"dim{i}" for i in range(len(keys)))
    agg = _AGG[spec.aggregation].format(c="x")
    return f"SELECT {names}, round(value, 4) AS value, n_rows FROM (SELECT {names}, {agg} AS value, count(*) AS n_rows FROM (SELECT {dims}, {spec.column} AS x FROM {source} WHERE {where}) GROUP BY {names}) WHERE value IS NOT NULL {tail}"


def _spec(name: str, spec: Spec, source: str = ORDERS, where: str = "true", tail: str = "") -> None:
    columns = (spec.column, *[x.column for x in (*spec.dimensions, *spec.filters)])
    read = (lambda s, d: S.sales(s, d, columns)) if source == "sales" else lambda s, d: S.table(s, d, source)
    _put(name, lambda s, d: _round(execute(read(s, d), spec), "value"), _sql(spec, S.SQL if source == "sales" else source, where, tail))


for how in ("sum", "mean", "median", "count", "count_distinct", "min", "max", "std"):
    column = "o_custkey" if how == "count_distinct" else "o_totalprice"
    _spec({"count": "agg_count", "count_distinct": "agg_count_distinct", "min": "agg_min", "max": "agg_max", "std": "agg_std"}.get(how, f"agg_{how}_by_month"), Spec(column, how, (MONTH,)))
_spec("agg_median_by_category", Spec("l_extendedprice", "median", (Dimension("p_type"),)), "sales")
_spec("agg_two_dims", Spec("o_totalprice", "sum", (MONTH, STATUS)))
for grain in ("day", "week", "month", "quarter", "year", "dayofweek"):
    _spec(f"grain_{grain}", Spec("o_totalprice", "sum", (Dimension("o_orderdate", "temporal", grain),)))
_spec("grain_hour", Spec("value", "sum", (Dimension("ts", "temporal", "hour"),)), "events")
for op, value, where in (
    ("eq", "F", "o_orderstatus = 'F'"), ("neq", "F", "o_orderstatus IS DISTINCT FROM 'F'"), ("in", ("F", "P"), "o_orderstatus IN ('F', 'P')"), ("not_in", ("F",), "o_orderstatus IS NULL OR o_orderstatus NOT IN ('F')"), ("not_null", None, "o_orderstatus IS NOT NULL"),
):
    _spec(f"filter_{op}", Spec("o_totalprice", "sum", (PRIORITY,), (Filter("o_orderstatus", op, value),)), where=where)
for op, value, where in (("gt", 1000, "> 1000"), ("gte", 1000, ">= 1000"), ("lt", 50000, "< 50000"), ("lte", 50000, "<= 50000"), ("between", (1000, 50000), "BETWEEN 1000 AND 50000")):
    _spec(f"filter_{op}", Spec("o_totalprice", "count", (PRIORITY,), (Filter("o_totalprice", op, value),)), where=f"o_totalprice {where}")
_spec("filter_conjunction", Spec("o_totalprice", "sum", (PRIORITY,), (Filter("o_orderstatus", "eq", "F"), Filter("o_totalprice", "gt", 1000), Filter("absent", "eq", 1), Filter("o_totalprice", "like", 1))), where="o_orderstatus = 'F' AND o_totalprice > 1000")
_spec("sort_by_measure", Spec("o_totalprice", "sum", (PRIORITY,), sort_by="measure", descending=True))
_spec("topk_desc", Spec("o_totalprice", "sum", (Dimension("o_custkey"),), sort_by="measure", descending=True, limit=10), tail="ORDER BY value DESC, dim0 LIMIT 10")
_spec("topk_asc", Spec("o_totalprice", "sum", (Dimension("o_custkey"),), sort_by="dimension", descending=False, limit=10), tail="ORDER BY value, dim0 LIMIT 10")
_spec("last_n_periods", Spec("o_totalprice", "sum", (MONTH,), sort_by="dimension", limit=6), tail="ORDER BY dim0 DESC LIMIT 6")
_TOP = Spec("o_totalprice", "sum", (Dimension("o_custkey"),), sort_by="measure", descending=True, limit=10)
_put("topk_with_totals", lambda s, d: _round(with_totals(S.table(s, d, "orders"), _TOP), "value", "total", digits=2), f"SELECT dim0, round(value, 2) AS value, n_rows, count(*) OVER () AS n_groups, round(sum(value) OVER (), 2) AS total FROM ({_sql(_TOP, 'orders')}) ORDER BY value DESC, dim0 LIMIT 10")
_COV = Spec("o_totalprice", "sum", (MONTH,), (Filter("o_orderstatus", "eq", "F"),))
_put("coverage_counts", lambda s, d: coverage(S.table(s, d, "orders"), _COV), "SELECT count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_filtered, count(*) FILTER (o_orderstatus = 'F' AND o_orderdate IS NULL) AS n_rows_excluded FROM orders")
# The guaranteed analyses over the denormalised sales.
_DATE = Dimension("o_orderdate", "temporal", "month")
_spec("g1_revenue_by_month", Spec("l_extendedprice", "sum", (_DATE,)), "sales")
_spec("g2_revenue_by_category", Spec("l_extendedprice", "sum", (Dimension("p_type"),), sort_by="measure", descending=True, limit=15), "sales", tail="ORDER BY value DESC, dim0 LIMIT 15")
_spec("g3_mean_revenue_by_month", Spec("l_extendedprice", "mean", (_DATE,)), "sales")
_spec("g4_revenue_by_dayofweek", Spec("l_extendedprice", "sum", (Dimension("o_orderdate", "temporal", "dayofweek"),)), "sales")
_spec("g5_revenue_by_product", Spec("l_extendedprice", "sum", (Dimension("p_name"),), sort_by="measure", descending=True, limit=15), "sales", tail="ORDER BY value DESC, dim0 LIMIT 15")
_spec("g6_revenue_by_region", Spec("l_extendedprice", "sum", (Dimension("n_name"),), sort_by="measure", descending=True, limit=12), "sales", tail="ORDER BY value DESC, dim0 LIMIT 12")
_spec("g7_customers_by_month", Spec("o_custkey", "count_distinct", (_DATE,)), "sales")

# Statistics and patterns over an aggregate.
_M = Spec("o_totalprice", "sum", (MONTH,))
_C = Spec("o_totalprice", "sum", (Dimension("o_custkey"),))
_monthly = lambda s, d: grouped(S.table(s, d, "orders"), _M)
_by_customer = lambda s, d: grouped(S.table(s, d, "orders"), _C)
_A, _B = f"({_sql(_M, 'orders')})", f"({_sql(_C, 'orders')})"
_put("stats_basic", lambda s, d: _round(stats.basic(_monthly(s, d)), "total", "mean", "median", "max", "min", digits=3), f"SELECT count(*) AS n_points, round(sum(value), 3) AS total, round(avg(value), 3) AS mean, round(median(value), 3) AS median, round(max(value), 3) AS max, round(min(value), 3) AS min FROM {_A}")
_EDGES = f"""e0 AS (SELECT *, row_number() OVER (ORDER BY dim0) AS place, count(*) OVER () AS n FROM {_A}),
e1 AS (SELECT *, median(CASE WHEN place > 1 AND place < n THEN value END) OVER () AS mv, median(CASE WHEN place > 1 AND place < n THEN n_rows END) OVER () AS mr FROM e0),
e AS (SELECT *, n >= 4 AND (place = 1 OR place = n) AND (value < 0.5 * mv OR n_rows < 0.5 * mr) AS partial FROM e1)"""
_put("partial_periods", lambda s, d: _round(stats.marked_edges(_monthly(s, d)).where("partial").select("dim0", "value", "n_rows", "place"), "value", digits=2), f"WITH {_EDGES} SELECT dim0, round(value, 2) AS value, n_rows, place FROM e WHERE partial")
_TREND = f"""WITH {_EDGES}, w AS (SELECT *, row_number() OVER (ORDER BY dim0) - 1 AS x FROM e WHERE NOT partial OR (SELECT count(*) FROM e WHERE NOT partial) < 2),
t AS (SELECT count(*) AS n, arg_min(value, x) AS first_value, arg_max(value, x) AS last_value, regr_slope(value, x) AS slope, CASE WHEN var_pop(value) = 0 THEN 0 ELSE regr_r2(value, x) END AS r2,
  avg(value) AS mean, stddev_samp(value) / (CASE WHEN avg(value) = 0 THEN 1 ELSE abs(avg(value)) END) * 100 AS volatility_pct FROM w),
u AS (SELECT *, (last_value - first_value) / nullif(abs(first_value), 0) * 100 AS change_pct FROM t),
v AS (SELECT *, CASE WHEN r2 < 0.25 OR abs(slope) / abs(mean) * 100 < 1 OR coalesce(sign(change_pct), 0) * sign(slope) < 0 THEN 'stable' WHEN slope > 0 THEN 'hausse' ELSE 'baisse' END AS direction FROM u)"""
_put("trend_change", lambda s, d: _round(stats.trend(_monthly(s, d)).select("first_value", "last_value", "change_absolute", "change_pct"), "first_value", "last_value", "change_absolute", "change_pct", digits=2), f"{_TREND} SELECT round(first_value, 2) AS first_value, round(last_value, 2) AS last_value, round(last_value - first_value, 2) AS change_absolute, round(change_pct, 2) AS change_pct FROM v")
_put("trend_regression", lambda s, d: _round(stats.trend(_monthly(s, d)).select("n", "slope", "r2", "volatility_pct"), "slope", "r2", "volatility_pct", digits=3), f"{_TREND} SELECT n, round(slope, 3) AS slope, round(r2, 3) AS r2, round(volatility_pct, 3) AS volatility_pct FROM v")
_put("trend_direction", lambda s, d: stats.trend(_monthly(s, d)).select("direction"), f"{_TREND} SELECT direction FROM v")
_put("pareto_share", lambda s, d: _round(stats.pareto(_by_customer(s, d)), "top20_share_pct", "top1_share_pct", digits=3), f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY value DESC, dim0) AS place, count(*) OVER () AS n, value / sum(value) OVER () AS share FROM {_B}),
q AS (SELECT *, sum(share) OVER (ORDER BY place) AS cum FROM p)
SELECT max(n) AS n_groups, round(sum(CASE WHEN place <= greatest(1, floor(n * 0.2)) THEN share END) * 100, 3) AS top20_share_pct, round(max(share) * 100, 3) AS top1_share_pct, count(*) FILTER (cum <= 0.8) + 1 AS n_for_80pct FROM q""")
# Totals of 0 and below, and groups that are all alike.
_shares = lambda a: f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY value DESC, dim0) AS place, count(*) OVER () AS n, sum(value) OVER () AS total FROM {a}),
q AS (SELECT *, sum(value) OVER (ORDER BY place) / nullif(total, 0) AS cum FROM p), r AS (SELECT max(n) AS n_groups, max(total) AS total, sum(CASE WHEN place <= greatest(1, floor(n * 0.2)) THEN value END) AS top, max(value) AS best, count(*) FILTER (cum <= 0.8) + 1 AS k FROM q)
SELECT n_groups, round(top / nullif(total, 0) * 100, 3) AS top20_share_pct, round(best / nullif(total, 0) * 100, 3) AS top1_share_pct, CASE WHEN total <> 0 THEN k END AS n_for_80pct FROM r"""  # noqa: E731


def _signed(name: str, amount: str, by: str, how: str = "sum") -> None:
    spec = Spec("x", how, (Dimension(by),))
    text = f"SELECT {by}, ({amount})::DOUBLE AS x FROM {{t}}"
    read = lambda s, d: s.sql(text.replace("{t}", "{o}"), o=S.table(s, d, "orders"))
    _put(name, lambda s, d: _round(stats.pareto(grouped(read(s, d), spec)), "top20_share_pct", "top1_share_pct", digits=3), _shares(f"({_sql(spec, '(' + text.format(t='orders') + ')')})"))


_signed("pareto_zero", "o_totalprice - o_totalprice", "o_custkey")
_signed("pareto_negative", "CASE WHEN o_custkey % 9 = 0 THEN o_totalprice ELSE -o_totalprice END", "o_custkey")
_signed("pareto_ties", "CASE WHEN o_custkey % 50 = 0 THEN 3 ELSE 1 END", "o_custkey", "max")
_ZERO = Spec("x", "sum", (PRIORITY,), title="zero")
_NIL = "SELECT o_orderpriority, (o_totalprice - o_totalprice)::DOUBLE AS x FROM {t}"
_shape = lambda k: F.get_json_object("facts", f"$.computed_stats.{k}")
_put("facts_zero", lambda s, d: facts.facts(s.sql(_NIL.replace("{t}", "{o}"), o=S.table(s, d, "orders")), _ZERO).select("n_groups", _shape("basic.total").cast("double").alias("total"), _shape("shape.top20_share_pct").cast("double").alias("top20"), F.get_json_object("facts", "$.coverage.n_rows").cast("long").alias("n_rows")), "SELECT count(*) AS n_groups, sum(value) AS total, NULL::DOUBLE AS top20, sum(n_rows)::BIGINT AS n_rows FROM (SELECT o_orderpriority, sum(x) AS value, count(*) AS n_rows FROM (" + _NIL.format(t="orders") + ") GROUP BY 1)")
_Z = "(SELECT *, 0.6745 * abs(value - med) / nullif(median(abs(value - med)) OVER (), 0) AS z FROM (SELECT *, median(value) OVER () AS med FROM {x}))"
_put("anomaly_spike", lambda s, d: _round(stats.spikes(_by_customer(s, d)), "value", "z", digits=3), f"SELECT dim0, round(value, 3) AS value, round(z, 3) AS z FROM {_Z.format(x=_B)} WHERE z > 3.5 AND value > med")
_put("long_tail", lambda s, d: stats.long_tail(_by_customer(s, d)), f"SELECT n_groups, n_small, n_groups >= 4 AND n_small >= greatest(3, 0.3 * n_groups) AS found FROM (SELECT count(*) AS n_groups, count(*) FILTER (share < 0.01) AS n_small FROM (SELECT value / sum(value) OVER () AS share FROM {_B}))")
_put("pattern_seasonal_peak", lambda s, d: _round(stats.peaks(_monthly(s, d), 1.1, "median", 8), "value", digits=2), f"SELECT dim0, round(value, 2) AS value FROM (SELECT *, median(value) OVER () AS mid, count(*) OVER () AS n FROM {_A}) WHERE n >= 8 AND value >= 1.1 * mid")
_put("mad_outliers", lambda s, d: _round(stats.with_robust_z(S.table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("value"))).where("z > 1.3").select("c_custkey", "value", "z"), "z"), f"SELECT c_custkey, value, round(z, 4) AS z FROM {_Z.format(x='(SELECT c_custkey, c_acctbal AS value FROM customer)')} WHERE z > 1.3")
_put("argmax_argmin", lambda s, d: stats.extremes(_monthly(s, d)), f"WITH a AS {_A} SELECT min(dim0) FILTER (value = (SELECT max(value) FROM a)) AS max_period, min(dim0) FILTER (value = (SELECT min(value) FROM a)) AS min_period FROM a")


def sampled_sql(most: int) -> str:
    return f"""SELECT dim0, round(value, 2) AS value FROM (SELECT *, row_number() OVER (ORDER BY dim0) AS place, count(*) OVER () AS n, greatest(1, count(*) OVER () // {most - 2}) AS step FROM {_A})
WHERE n <= {most} OR place = 1 OR place = n OR ((place - 2) % step = 0 AND place >= 2 AND (place - 2) // step < {most - 2})"""


_put("downsample_points", lambda s, d: _round(facts.sampled_points(_monthly(s, d), 12).select("dim0", "value"), "value", digits=2), sampled_sql(12))

# The benchmark's operations.
_MONTH_CATEGORY = Spec("l_extendedprice", "sum", (_DATE, Dimension("p_type")))
_put("bench_month_category", lambda s, d: grouped(S.sales(s, d, ("o_orderdate", "p_type", "l_extendedprice")), _MONTH_CATEGORY).select(F.col("dim0").alias("month"), F.col("dim1").alias("category"), F.round("value", 2).alias("amount")), f"SELECT strftime(o_orderdate, '%Y-%m') AS month, p_type AS category, round(sum(l_extendedprice), 2) AS amount FROM {S.SQL} GROUP BY ALL")
_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
_put("cardinality_all_columns", lambda s, d: S.table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(c) for c in _COLS]), "SELECT count(*) AS n, " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in _COLS) + " FROM lineitem")
_put("view_count", lambda s, d: view(S.table(s, d, "lineitem"), "tallymark_lines").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem")
_put("left_join_group_sizes", lambda s, d: grouped(S.table(s, d, "orders"), Spec("o_totalprice", "max", (PRIORITY,))), "SELECT o_orderpriority AS dim0, max(o_totalprice) AS value, count(*) AS n_rows FROM orders GROUP BY 1")
_put("perimeter", lambda s, d: _round(report.perimeter(S.table(s, d, "orders"), "o_totalprice", "o_orderdate").drop("n_without_amount"), "amount", digits=2), "SELECT count(*) AS n_rows, round(sum(o_totalprice), 2) AS amount, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, date_diff('day', min(o_orderdate), max(o_orderdate))::BIGINT AS days FROM orders")
_PLAN = guaranteed({"order_date": "o_orderdate", "revenue": "l_extendedprice", "product_category": "p_type", "region": "n_name", "customer_id": "o_custkey"})
_PLAN_COLUMNS = tuple(sorted({c for x in _PLAN for c in (x.column, *[y.column for y in (*x.dimensions, *x.filters)])}))
_put("run_plan", lambda s, d: _round(report.run_all(S.sales(s, d, _PLAN_COLUMNS), _PLAN), "value"), " UNION ALL ".join(f"SELECT '{x.title}' AS spec, dim0, value, n_rows FROM ({_sql(x, S.SQL)})" for x in _PLAN))
# Every kind of aggregate, filters and a second dimension in one scan.
_KINDS = (
    *[Spec("o_totalprice", how, (MONTH,), title=how) for how in ("sum", "mean", "median", "count", "min", "max", "std")], Spec("o_custkey", "count_distinct", (PRIORITY,), title="customers"),
    Spec("o_totalprice", "median", (PRIORITY,), (Filter("o_orderstatus", "eq", "F"),), title="median of F"), Spec("o_totalprice", "sum", (PRIORITY,), (Filter("o_totalprice", "gt", 100_000),), title="large"),
)
_WHERE = {"median of F": "o_orderstatus = 'F'", "large": "o_totalprice > 100000"}
_put("run_plan_kinds", lambda s, d: _round(report.run_all(S.table(s, d, "orders"), list(_KINDS)), "value"), " UNION ALL ".join(f"SELECT '{x.title}' AS spec, dim0, value, n_rows FROM ({_sql(x, 'orders', _WHERE.get(x.title, 'true'))})" for x in _KINDS))


def _plan_coverage(s, d):
    """Coverage of each spec, from the one scan of all."""
    parts = written(aggregated(S.table(s, d, "orders"), list(_KINDS)))
    return reduce(DataFrame.unionByName, [coverage_of(parts, k).withColumn("spec", F.lit(x.title)) for k, x in enumerate(_KINDS)])


_put("run_plan_coverage", _plan_coverage, " UNION ALL ".join(f"SELECT '{x.title}' AS spec, count(*) AS n_rows, count(*) FILTER ({_WHERE.get(x.title, 'true')}) AS n_filtered, count(*) FILTER (({_WHERE.get(x.title, 'true')}) AND {x.dimensions[0].column} IS NULL) AS n_rows_excluded FROM orders" for x in _KINDS))
_put("orders_per_customer", lambda s, d: _round(patterns.orders_per_customer(S.table(s, d, "orders"), "o_orderkey", "o_custkey"), "ratio", digits=6), "SELECT count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, round(count(DISTINCT o_orderkey) / count(DISTINCT o_custkey), 6) AS ratio FROM orders")
_put("applied_filters", lambda s, d: filtered(S.table(s, d, "orders"), (Filter("o_totalprice", "gt", 1000), Filter("absent", "eq", 1)))[0].agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000")
