"""Queries of patterns, facts, number checks, sectors, types, derivations and the stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import text as X
from tallymark.operators import facts, patterns, profile, quality, sector, verify
from tallymark.operators.clean import Cleaner
from tallymark.operators.execute import grouped, present_values
from tallymark.plans import mapping
from tallymark.plans.spec import Dimension, Spec
from tallymark.quality_queries import _D, _plain, _trim, dirty
from tallymark.queries import _M, _TREND, _monthly, _sql, sampled_sql
from tallymark.sources import sales as S
from tallymark.sources.scan import scan, write_csv
from tallymark.streaming import daily_rollup, run_daily_rollup

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _put(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _pattern(name, query, sql):
    """Name and confidence of a pattern; evidence is JSON text, which the engines write differently."""
    _put(f"pattern_{name}", lambda s, d: query(s, d).select("pattern_id", F.round("confidence", 3).alias("confidence")), sql)


_orders = lambda s, d: S.table(s, d, "orders")
_FIELDS = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate"


def _shaped(name, spec, amount, query, sql, customer="o_custkey"):
    """A pattern at the rules' own factors, over all orders with amounts that show it; {dow} counts days from Monday in each engine."""
    table = f"SELECT {_FIELDS}, {customer} AS customer, ({amount}) AS x FROM {{t}}"
    source = "(" + table.replace("{dow}", "(isodow(o_orderdate) - 1)").format(t="orders") + ")"
    _pattern(name, lambda s, d: query(grouped(s.sql(table.replace("{dow}", "weekday(o_orderdate)").replace("{t}", "{o}"), o=_orders(s, d)), spec)), sql(f"({_sql(spec, source)})"))


_year = Spec("x", "sum", (Dimension("o_orderdate", "temporal", "year"),))
_month = Spec("x", "sum", (Dimension("o_orderdate", "temporal", "month"),))
_week = Spec("x", "sum", (Dimension("o_orderdate", "temporal", "dayofweek"),))
_mean = Spec("x", "mean", (Dimension("o_orderdate", "temporal", "year"),))
_by = lambda c: Spec("x", "sum", (Dimension(c),))
_A = f"({_sql(_M, 'orders')})"
_of_trend = lambda what, where: lambda a: _TREND.replace(_A, a) + f" SELECT {what} FROM v WHERE {where}"
_grown = "n >= 4 AND r2 > 0.25 AND direction <> 'stable' AND abs(slope) > 0.02 * mean"
_name = "CASE WHEN direction = 'baisse' THEN 'trend_decline' ELSE 'trend_growth' END AS pattern_id, round(least(0.95, r2 + 0.3), 3) AS confidence"
_fixed = lambda name, sure: f"'{name}' AS pattern_id, {sure}::DOUBLE AS confidence"
_YEAR = "extract(year FROM o_orderdate)"

_shaped("trend", _year, f"o_totalprice * ({_YEAR} - 1990)", patterns.trend, _of_trend(_name, _grown))
_shaped("trend_decline", _year, f"o_totalprice * (2004 - {_YEAR})", patterns.trend, _of_trend(_name, _grown))
_shaped("anomaly_spike", _month, f"o_totalprice * CASE WHEN {_YEAR} = 1995 AND extract(month FROM o_orderdate) = 6 THEN 20 ELSE 1 END", patterns.spike, lambda a: f"SELECT {_fixed('anomaly_spike', 0.8)} FROM (SELECT count(*) AS n, count(*) FILTER (0.6745 * abs(value - med) / nullif(mad, 0) > 3.5 AND value > med) AS k FROM (SELECT *, median(abs(value - med)) OVER () AS mad FROM (SELECT *, median(value) OVER () AS med FROM {a}))) WHERE n >= 4 AND k BETWEEN 1 AND greatest(2, n // 5)")
_pareto = lambda a: f"SELECT {_fixed('pareto_concentration', 0.9)} FROM (SELECT *, row_number() OVER (ORDER BY value DESC, dim0) AS place, count(*) OVER () AS n, value / sum(value) OVER () AS share FROM {a}) WHERE n >= 4 AND place <= greatest(1, floor(n * 0.2)) HAVING sum(share) >= 0.75"
_zone = lambda a: f"SELECT {_fixed('geographic_concentration', 0.85)} FROM {a} HAVING count(*) >= 2 AND max(value) / sum(value) >= 0.5"
_tail = lambda a: f"SELECT {_fixed('long_tail_dead_stock', 0.75)} FROM (SELECT value / sum(value) OVER () AS share FROM {a}) HAVING count(*) >= 4 AND count(*) FILTER (share < 0.01) >= greatest(3, 0.3 * count(*))"
_shaped("pareto", _by("o_custkey"), "o_totalprice * CASE WHEN o_custkey % 10 = 0 THEN 100 ELSE 1 END", patterns.pareto, _pareto)
_shaped("geographic", _by("o_orderstatus"), "o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 1 END", patterns.geographic, _zone)
_shaped("long_tail", _by("o_custkey"), "o_totalprice", patterns.long_tail, _tail)
_shaped("day_of_week", _week, "o_totalprice * CASE WHEN {dow} = 2 THEN 3 ELSE 1 END", patterns.weekday_peak, lambda a: f"SELECT {_fixed('day_of_week_peak', 0.85)} FROM (SELECT value, avg(value) OVER () AS mean FROM {a}) HAVING count(*) >= 5 AND count(*) FILTER (value >= 1.4 * mean) > 0")
_shaped("seasonal", _month, "o_totalprice * CASE WHEN extract(month FROM o_orderdate) = 12 THEN 4 ELSE 1 END", patterns.seasonal_peak, lambda a: f"SELECT {_fixed('seasonal_peak', 0.8)} FROM (SELECT value, median(value) OVER () AS mid FROM {a}) HAVING count(*) >= 8 AND count(*) FILTER (value >= 1.8 * mid) BETWEEN 1 AND count(*) // 3")
_shaped("basket_erosion", _mean, f"o_totalprice * (2004 - {_YEAR})", patterns.basket_erosion, _of_trend(_fixed("basket_erosion", 0.8), "n >= 3 AND change_pct < -10 AND direction = 'baisse'"))
_ONCE = "CASE WHEN o_orderkey % 10 = 0 THEN o_custkey ELSE -o_orderkey END"
_pattern("single_purchase", lambda s, d: patterns.single_purchase(_orders(s, d), "o_orderkey", "o_custkey"), "SELECT 'single_purchase_dominance' AS pattern_id, 0.85::DOUBLE AS confidence FROM orders HAVING count(DISTINCT o_orderkey) / count(DISTINCT o_custkey) < 1.3")
_pattern("single_purchase_found", lambda s, d: patterns.single_purchase(s.sql(f"SELECT o_orderkey, {_ONCE} AS customer FROM {{o}}", o=_orders(s, d)), "o_orderkey", "customer"), f"SELECT 'single_purchase_dominance' AS pattern_id, 0.85::DOUBLE AS confidence FROM (SELECT o_orderkey, {_ONCE} AS customer FROM orders) HAVING count(DISTINCT o_orderkey) / count(DISTINCT customer) < 1.3")
_priority = _by("o_orderpriority")
_shaped("all", _priority, "o_totalprice * CASE WHEN o_orderpriority = '1-URGENT' THEN 1000 ELSE 1 END", lambda agg: patterns.detect(agg, _priority, role="region"), lambda a: " UNION ALL ".join(f"({x(a)})" for x in (_pareto, _zone, _tail)))

_SPECS = (Spec("o_totalprice", "sum", (Dimension("o_orderdate", "temporal", "month"),), chart="line", title="Revenue by month"), Spec("o_totalprice", "sum", (Dimension("o_orderpriority"),), title="Revenue by priority"))
_put("facts_json", lambda s, d: facts.facts(_orders(s, d), _SPECS[0]).unionByName(facts.facts(_orders(s, d), _SPECS[1])))
_put("facts_for_llm", lambda s, d: facts.sampled_points(_monthly(s, d)).select("dim0", F.round("value", 2).alias("value")), sampled_sql(30))

# Number checks: documents are the texts, and word counts of a text are facts about it.
_put("extract_numbers", lambda s, d: verify.numbers(S.table(s, d, "documents"), "doc_id", "text"))
# Totals of every kind: years, small numbers, nulls, zeros and negative ones among them; one in ten is cited at twice its value.
_TOTALS = "SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 1850 + o_orderkey % 300 WHEN o_orderkey % 31 = 0 THEN o_orderkey % 12 WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 0 WHEN o_orderkey % 43 = 0 THEN -o_totalprice ELSE o_totalprice END AS total FROM {t}"
_CITED = "SELECT o_orderkey AS report, concat('Montant ', cast(cast(total * CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS DECIMAL(18,2)) AS VARCHAR(30)), ' en hausse de 3 actions') AS t, total AS value FROM (" + _TOTALS + ")"
# The rules by value: numbers that are ignored, then a match with the total, its absolute or its rounded value.
_JUDGED = "(SELECT CASE WHEN v IN (0, 1, 2, 3, 4, 5, 10, 100) OR (v BETWEEN 1900 AND 2100 AND v = floor(v)) THEN 'ignored' WHEN " + " OR ".join(f"abs(v - {x}) <= 0.005 * abs({x})" for x in ("total", "abs(total)", "round_even(total, 0)")) + " THEN 'verified' ELSE 'unverified' END AS status FROM (SELECT total, CAST(total * CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS DECIMAL(18,2))::DOUBLE AS v FROM (" + _TOTALS.format(t="orders") + ") WHERE total IS NOT NULL))"


def _checked(s, d):
    cited = s.sql(_CITED.format(t="{t}"), t=_orders(s, d))
    return verify.verified(verify.numbers(cited, "report", "t"), cited.select("report", F.lit("total").alias("path"), "value"))


_put("verify_numbers", lambda s, d: _checked(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"SELECT status, sum(n)::BIGINT AS n FROM (SELECT status, count(*) AS n FROM {_JUDGED} GROUP BY 1 UNION ALL SELECT 'ignored', count(*) FROM {_JUDGED}) GROUP BY 1 HAVING sum(n) > 0")
_put("fidelity", lambda s, d: verify.fidelity(_checked(s, d)).groupBy("fidelity").agg(F.count(F.lit(1)).alias("n_reports"), F.sum("n_named").alias("n_named")), f"SELECT CASE WHEN status = 'unverified' THEN 0.0 ELSE 1.0 END::DOUBLE AS fidelity, count(*) AS n_reports, (2 * count(*))::BIGINT AS n_named FROM {_JUDGED} GROUP BY 1")

_put("label_filter", lambda s, d: S.table(s, d, "part").select("p_partkey", sector.is_label(F.col("p_name")).alias("name_ok"), sector.is_label(F.col("p_brand")).alias("brand_ok")), "SELECT p_partkey, " + ", ".join(
    f"length(trim({c})) > 2 AND len(regexp_extract_all({c}, '\\p{{L}}')) >= 3 AND NOT (len(regexp_extract_all({c}, '\\p{{Nd}}')) > 0 AND (len(regexp_extract_all({c}, '\\p{{L}}')) <= len(regexp_extract_all({c}, '\\p{{Nd}}')) OR (NOT contains(trim({c}), ' ') AND length(trim({c})) <= 10))) AS {a}"
    for c, a in (("p_name", "name_ok"), ("p_brand", "brand_ok"))) + " FROM part")
_LEX = {"metals": ("brass", "steel", "tin", "copper", "nickel"), "sizes": ("small", "large", "medium", "economy")}
_put("sector_lexicon", lambda s, d: sector.scores(S.table(s, d, "part").select(F.col("p_type").alias("label")), _LEX).select("sector", "score"), " UNION ALL ".join(f"SELECT '{k}' AS sector, sum(" + " + ".join(f"len(regexp_extract_all(lower(p_type), '\\b{w}'))" for w in ws) + f")::BIGINT AS score FROM part HAVING sum(" + " + ".join(f"len(regexp_extract_all(lower(p_type), '\\b{w}'))" for w in ws) + ") > 0" for k, ws in _LEX.items()))
# A lexicon that is a table: the last words of product names, by their first letter.
_WORDS = "SELECT DISTINCT concat('kind ', substr(element_at(split(p_name, ' '), -1), 1, 1)) AS sector, element_at(split(p_name, ' '), -1) AS word FROM {p}"
_put("sector_lexicon_table", lambda s, d: sector.scores(S.table(s, d, "part").select(F.col("p_name").alias("label")), s.sql(_WORDS, p=S.table(s, d, "part"))).select("sector", "score"), "WITH l AS (SELECT DISTINCT 'kind ' || substr(w, 1, 1) AS sector, w FROM (SELECT list_extract(string_split(p_name, ' '), -1) AS w FROM part)), t AS (SELECT unnest(string_split(lower(p_name), ' ')) AS token FROM part) SELECT sector, count(*) AS score FROM t JOIN l ON starts_with(token, lower(w)) GROUP BY 1")
_TOP = "(SELECT p_type FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 60) WHERE length(trim(p_type)) > 2 AND len(regexp_extract_all(p_type, '\\p{L}')) >= 3)"
_HITS = " UNION ALL ".join(f"SELECT '{k}' AS sector, sum(" + " + ".join(f"len(regexp_extract_all(lower(p_type), '\\b{w}'))" for w in ws) + f")::DOUBLE AS n FROM {_TOP}" for k, ws in _LEX.items())
_put("sector", lambda s, d: sector.sector(sector.labels(S.table(s, d, "part"), "p_type"), _LEX).drop("words"), f"SELECT CASE WHEN confidence >= 0.35 THEN sector END AS sector, confidence, confidence < 0.7 AS to_confirm FROM (SELECT sector, round(CASE WHEN second IS NULL THEN CASE WHEN n >= 3 THEN 0.95 ELSE 0.6 END ELSE least(0.95, greatest(0, (n / (n + second) - 0.5) * 2.4) * CASE WHEN n < 3 THEN 0.6 ELSE 1 END) END, 2)::DOUBLE AS confidence FROM (SELECT *, lead(n) OVER (ORDER BY n DESC, sector) AS second, row_number() OVER (ORDER BY n DESC, sector) AS place FROM ({_HITS}) WHERE n > 0) WHERE place = 1)")

_TYPED = "SELECT cast(o_orderkey AS VARCHAR(30)) AS key, cast(cast(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)) AS amount, {day} AS day, CASE WHEN o_orderkey % 3 = 0 THEN 'oui' ELSE 'non' END AS paid, CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE o_orderpriority END AS note FROM {t}"
_put("infer_types", lambda s, d: profile.text_types(s.sql(_TYPED.format(t="{t}", day="date_format(o_orderdate, 'dd/MM/yyyy')"), t=_orders(s, d)), ["key", "amount", "day", "paid", "note"]), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*){f} AS n, '{t}' AS type FROM orders" for c, t, f in (("key", "numeric", ""), ("amount", "numeric", ""), ("day", "datetime", ""), ("paid", "boolean", ""), ("note", "text", " FILTER (o_orderkey % 11 <> 0)"))))
_put("parse_dates_mixed", lambda s, d: s.sql("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'd/M/yyyy') WHEN o_orderkey % 3 = 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE 'hier' END AS t FROM {t}", t=_orders(s, d)).select("o_orderkey", F.date_format(X.parsed_date(F.col("t"), profile.DATE_FORMATS), "yyyy-MM-dd").alias("day")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")


def _strategies_sql():
    names = ("o_orderkey", "o_custkey", "o_orderstatus")
    role = lambda c, t: f"(SELECT CASE WHEN count(DISTINCT {c}) / count(*) > 0.9 THEN 'identifier' WHEN count(DISTINCT {c}) <= 200 THEN 'categorical' ELSE 'high_cardinality' END FROM {t})"
    head = "(SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000)"
    wrong = [f"CASE WHEN {role(c, 'orders')} <> {role(c, head)} THEN '{c}' END" for c in names]
    return f"WITH w AS (SELECT list_filter([{', '.join(wrong)}], lambda x: x IS NOT NULL) AS l) SELECT 'head' AS strategy, (3 - len(l))::INT AS n_right, (3 - len(l)) / 3 AS accuracy, array_to_string(l, ',') AS wrong FROM w UNION ALL SELECT s, 3::INT, 1.0::DOUBLE, '' FROM (VALUES ('full'), ('hybrid')) t(s)"


_put("cardinality_roles", lambda s, d: profile.simple_roles(_orders(s, d), ["o_orderkey", "o_custkey", "o_orderstatus"]), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, CASE WHEN count(DISTINCT {c}) / count(*) > 0.9 THEN 'identifier' WHEN count(DISTINCT {c}) <= 200 THEN 'categorical' ELSE 'high_cardinality' END AS role FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus")))


_put("sampling_error", lambda s, d: profile.sampling_error(_orders(s, d), ["o_orderkey", "o_custkey", "o_orderstatus"], 0.1))
_put("compare_strategies", lambda s, d: profile.strategies(_orders(s, d), ["o_orderkey", "o_custkey", "o_orderstatus"], "o_orderkey", 1000), _strategies_sql())
_put("derive_alias", lambda s, d: mapping.derive(_orders(s, d), "alias", ("o_totalprice",), "revenue").select("o_orderkey", "revenue"), "SELECT o_orderkey, o_totalprice AS revenue FROM orders")
_put("clean_absurd_dates", lambda s, d: Cleaner(s.sql("SELECT o_orderkey, o_totalprice AS amount, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP_NTZ '1900-01-01 00:00:00' ELSE o_orderdate END AS day FROM {t}", t=_orders(s, d)), "o_orderkey", "amount", "day", decisions={"T04_absurd_dates": "null"}).result().select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day")), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
_put("clean_drop_columns", lambda s, d: quality.without_empty(_orders(s, d).withColumns({"void": F.lit(None).cast("string"), "same": F.lit("x")})).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderstatus").alias("n_status")), "SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS n_status FROM orders")
_put("status_column_probe", lambda s, d: quality.status_columns(dirty(s, d), ["priority", "remark", "status"]), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_status_values FROM (SELECT DISTINCT {c} AS c FROM {_D}) WHERE {_plain('c')} IN ({', '.join(repr(x) for x in X.CANCELLED)}) HAVING count(*) > 0" for c in ("priority", "remark", "status")))
_put("validate_filter_values", lambda s, d: present_values(_orders(s, d), "o_orderstatus", ["F", "P", "absent"]), "SELECT DISTINCT o_orderstatus AS value FROM orders WHERE o_orderstatus IN ('F', 'P', 'absent')")
_put("internal_orders", lambda s, d: quality.dominant_value(_orders(s, d), "o_orderstatus", 0.05), "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 0.05 * (SELECT count(*) FROM orders) ORDER BY n DESC, value LIMIT 1")
_put("whitespace_values", lambda s, d: quality.counts(dirty(s, d), n_padded=F.col("priority") != X.trimmed(F.col("priority"))), f"SELECT count(*) AS n_rows, count(*) FILTER (priority <> {_trim.format(c='priority')}) AS n_padded FROM {_D}")
_put("cancelled_with_amount", lambda s, d: quality.counts(dirty(s, d), n_cancelled_paid=X.is_cancelled_exactly(F.col("status")) & (F.col("amount") > 0)), f"SELECT count(*) AS n_rows, count(*) FILTER ({_plain('status')} IN ({', '.join(repr(x) for x in X.CANCELLED)}) AND amount > 0) AS n_cancelled_paid FROM {_D}")
_put("shipping_exceeds_amount", lambda s, d: quality.shipping_excess(_orders(s, d).withColumn("shipping", F.col("o_orderkey") % 1000 * 100.0), "o_totalprice", "shipping"), "SELECT count(*) AS n_rows, count(*) FILTER (o_totalprice > 0 AND o_orderkey % 1000 * 100.0 > 2 * o_totalprice) AS n_over FROM orders")
_put("implied_price_outlier", lambda s, d: quality.implied_price_outliers(S.table(s, d, "lineitem"), "l_extendedprice", "l_quantity"), "SELECT count(*) AS n, count(*) FILTER (0.6745 * abs(p - med) / nullif(mad, 0) > 15 AND NOT p BETWEEN med / 50 AND med * 50) AS n_off FROM (SELECT *, median(abs(p - med)) OVER () AS mad FROM (SELECT *, median(p) OVER () AS med FROM (SELECT l_extendedprice / nullif(l_quantity, 0) AS p FROM lineitem) WHERE p > 0))")
_put("insufficient_span", lambda s, d: quality.short_span(S.table(s, d, "events"), "ts"), "SELECT date_diff('day', min(ts), max(ts))::BIGINT AS span_days, date_diff('day', min(ts), max(ts)) < 56 AS short FROM events")
def _scanned(s, d):
    from tallymark.sources.scan import scratch_folder

    path = f"{scratch_folder(s)}/orders"
    write_csv(_orders(s, d).select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return scan(s, path)[0].select("o_orderkey", "o_orderstatus", "o_orderpriority")


_put("scan_csv", _scanned, "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")


def _streamed(s, d, mode="complete"):
    from tallymark.sources.scan import scratch_folder

    return run_daily_rollup(s, f"{d}/events.parquet", scratch_folder(s), mode).select("day", "event_type", "n", F.round("value", 4).alias("value"))


_DAILY = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"
_put("events_daily", lambda s, d: daily_rollup(S.table(s, d, "events")).select("day", "event_type", "n", F.round("value", 4).alias("value")), _DAILY)
_put("stream_events_daily", _streamed, _DAILY)
_put("stream_events_updates", lambda s, d: _streamed(s, d, "update"), _DAILY)
