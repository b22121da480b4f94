"""Queries of profiles, detectors and cleaning over a table that is made dirty by the same expressions in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions import text as X
from tallymark.operators import profile, quality
from tallymark.operators.clean import Cleaner
from tallymark.operators.report import lost_categories, plausibility
from tallymark.plans import mapping
from tallymark.sources import sales as S

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_DIRTY = """SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 7 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 31 = 0 THEN concat('  ', o_orderpriority, ' ') ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' WHEN o_orderkey % 13 = 0 THEN '-' WHEN o_orderkey % 1009 = 0 THEN 'TOTAL' WHEN o_orderkey % 997 = 0 THEN 'test order' ELSE o_orderpriority END AS remark,
  CASE o_orderstatus WHEN 'P' THEN 'Shipped - Lost in Transit' WHEN 'O' THEN 'Annulé' ELSE 'Livré' END AS status,
  CASE WHEN o_orderkey % 17 = 0 THEN -o_totalprice WHEN o_orderkey % 19 = 0 THEN 0 WHEN o_orderkey % 23 = 0 THEN o_totalprice * 1000 ELSE o_totalprice END AS amount,
  o_orderdate AS day FROM {t}"""
_D = "(" + _DIRTY.format(t="orders") + ")"


def dirty(spark, sf_dir):
    return spark.sql(_DIRTY.format(t="{t}"), t=S.table(spark, sf_dir, "orders"))


def _put(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _r(df, digits=4):
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


_lit = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"
_trim = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_plain = lambda c: f"strip_accents(lower({_trim.format(c=c)}))"
_cancelled = f"({_plain('status')} IN {_lit(X.CANCELLED)} OR regexp_matches({_plain('status')}, '\\b(" + "|".join(t for t in X.CANCELLED if len(t) >= 6) + ")'))"
_missing = f"(remark IS NULL OR lower({_trim.format(c='remark')}) IN {_lit(X.NULL_TOKENS)})"

_put("profile_numeric", lambda s, d: _r(profile.numeric(dirty(s, d), "amount"), 2).drop("skew"), f"SELECT count(amount) AS n, round(min(amount), 2) AS min, round(max(amount), 2) AS max, round(avg(amount), 2) AS mean, round(median(amount), 2) AS median, round(stddev_samp(amount), 2) AS std, count(*) FILTER (amount < 0) AS n_negative, count(*) FILTER (amount = 0) AS n_zero FROM {_D}")
_put("profile_skew", lambda s, d: _r(profile.numeric(S.table(s, d, "orders"), "o_totalprice").select("skew")), "SELECT round(skewness(o_totalprice), 4) AS skew FROM orders")
_put("profile_temporal", lambda s, d: profile.temporal(S.table(s, d, "orders"), "o_orderdate", F.lit("2001-01-01").cast("timestamp_ntz")), "SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, date_diff('day', min(o_orderdate), max(o_orderdate))::BIGINT AS span_days, count(*) FILTER (o_orderdate > TIMESTAMP '2001-01-01') AS n_future FROM orders")
_put("profile_cardinality", lambda s, d: _r(profile.cardinality(dirty(s, d), "remark"), 8), f"SELECT count(*) AS n, count(*) FILTER {_missing.join(('(', ')'))} AS n_null, count(DISTINCT CASE WHEN NOT {_missing} THEN remark END) AS n_unique, round(count(DISTINCT CASE WHEN NOT {_missing} THEN remark END) / count(CASE WHEN NOT {_missing} THEN remark END), 8) AS ratio FROM {_D}".replace("FILTER ((", "FILTER (WHERE (").replace("(WHERE (remark", "(WHERE (remark"))
_put("profile_nulls", lambda s, d: quality.counts(dirty(s, d), n_null=X.is_null_token(F.col("remark"))), f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_missing}) AS n_null FROM {_D}")
_put("top_values", lambda s, d: profile.top_values(S.table(s, d, "part"), "p_type"), "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")


def _role_sql(c, kind, decimals=False):
    """The rules of roles for a name that hints at nothing."""
    u, n = f"count(DISTINCT {c})", f"count({c})"
    number = f"WHEN {u} = 2 THEN 'boolean_flag' WHEN {u} / {n} > 0.05 OR {decimals} THEN 'measure' ELSE 'categorical'" if kind == "numeric" else f"WHEN {u} = 2 THEN 'boolean_flag' WHEN {u} <= 200 THEN 'categorical' ELSE 'high_cardinality_cat'"
    return f"SELECT '{c}' AS \"column\", CASE WHEN {n} = 0 THEN 'empty' WHEN {u} = 1 THEN 'constant' " + ("ELSE 'temporal'" if kind == "datetime" else f"WHEN {u} / {n} > 0.9 AND {n} > 20 AND NOT {decimals} THEN 'identifier' {number}") + " END AS role FROM orders"


_put("infer_roles", lambda s, d: s.createDataFrame(sorted(profile.roles(S.table(s, d, "orders").drop("o_totalprice")).items()), "column string, role string"), " UNION ALL ".join(_role_sql(c, k) for c, k in (("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_orderdate", "datetime"), ("o_orderpriority", "text"))))


def _profiles(s, d):
    rows = [(p.name, p.type, p.role, p.n, p.n_present, p.n_unique, p.min, p.max, p.n_negative, p.n_zero) for p in profile.table(dirty(s, d).drop("day"))]
    return s.createDataFrame(rows, "column string, type string, role string, n long, n_present long, n_unique long, min double, max double, n_negative long, n_zero long")


_put("profile_table", _profiles, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, {r} AS role, count(*) AS n, count({v}) AS n_present, count(DISTINCT {v}) AS n_unique, {f'min({c})::DOUBLE' if t == 'numeric' else 'NULL::DOUBLE'} AS min, {f'max({c})::DOUBLE' if t == 'numeric' else 'NULL::DOUBLE'} AS max, {f'count(*) FILTER ({c} < 0)' if t == 'numeric' else '0::BIGINT'} AS n_negative, {f'count(*) FILTER ({c} = 0)' if t == 'numeric' else '0::BIGINT'} AS n_zero FROM {_D}"
    for c, t, r, v in (("o_orderkey", "numeric", "'identifier'", "o_orderkey"), ("o_custkey", "numeric", "CASE WHEN count(DISTINCT o_custkey) / count(*) > 0.05 THEN 'measure' ELSE 'categorical' END", "o_custkey"), ("priority", "text", "'categorical'", "priority"), ("remark", "text", "'categorical'", f"CASE WHEN NOT {_missing} THEN remark END"), ("status", "text", "'categorical'", "status"), ("amount", "numeric", "'measure'", "amount"))))
_put("map_columns", lambda s, d: s.createDataFrame(sorted(mapping.build(mapping.facts_of(profile.table(S.table(s, d, "orders")))).columns.items()), "concept string, column string"), "SELECT * FROM (VALUES ('customer_id', 'o_custkey'), ('order_date', 'o_orderdate'), ('order_id', 'o_orderkey'), ('order_status', 'o_orderstatus'), ('revenue', 'o_totalprice')) t(concept, \"column\")")
_put("total_rows", lambda s, d: dirty(s, d).where(quality.total_rows(dirty(s, d))).select("o_orderkey", "remark"), f"SELECT o_orderkey, remark FROM {_D} WHERE {_plain('remark')} IN {_lit(X.TOTAL_TOKENS)}")
_put("test_rows", lambda s, d: S.table(s, d, "documents").where(X.has_test_word(F.col("text"))).select("doc_id"), "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(" + "|".join(X.TEST_TOKENS) + ")([^\\p{L}\\p{N}_]|$)')")
_put("exact_duplicates", lambda s, d: quality.exact_duplicates(S.table(s, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id"), "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
_put("near_duplicates", lambda s, d: quality.near_duplicates(S.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS a FROM orders) WHERE k > 1 AND a = 1")
_put("multiline_orders", lambda s, d: quality.multiline(S.table(s, d, "lineitem"), "l_orderkey"), "SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1 HAVING count(*) > 1")
_VAR = "SELECT spelling, n, first_value(spelling) OVER (PARTITION BY k ORDER BY n DESC, spelling) AS best FROM (SELECT *, count(*) OVER (PARTITION BY k) AS m FROM (SELECT {c} AS spelling, {k} AS k, count(*) AS n FROM {t} GROUP BY 1, 2)) WHERE m > 1"
_put("case_variants", lambda s, d: quality.case_variants(dirty(s, d), "priority"), _VAR.format(c="priority", k="lower(priority)", t=_D))
_put("accent_variants", lambda s, d: quality.accent_variants(s.sql("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Livre' WHEN o_orderkey % 3 = 1 THEN 'Livré' ELSE 'Perdu' END AS c FROM {t}", t=S.table(s, d, "orders")), "c"), _VAR.format(c="c", k="strip_accents(lower(c))", t="(SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Livre' WHEN o_orderkey % 3 = 1 THEN 'Livré' ELSE 'Perdu' END AS c FROM orders)"))
_put("near_duplicate_labels", lambda s, d: quality.near_labels(S.table(s, d, "part"), "p_brand").select("a", "b", "distance"), "SELECT a.p_brand AS a, b.p_brand AS b, levenshtein(a.p_brand, b.p_brand) AS distance FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON a.p_brand < b.p_brand WHERE levenshtein(a.p_brand, b.p_brand) <= 1 OR (levenshtein(a.p_brand, b.p_brand) <= 2 AND least(length(a.p_brand), length(b.p_brand)) >= 8)")
_put("cancelled_orders", lambda s, d: quality.counts(dirty(s, d), n_cancelled=X.is_cancelled(F.col("status"))), f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_cancelled}) AS n_cancelled FROM {_D}")
_put("extreme_outliers", lambda s, d: quality.extreme_outliers(dirty(s, d), "o_orderkey", "amount"), f"SELECT o_orderkey, amount AS value FROM (SELECT *, 0.6745 * abs(amount - med) / median(abs(amount - med)) OVER () AS z FROM (SELECT *, median(amount) OVER () AS med FROM {_D})) WHERE z > 10 AND abs(amount) > 20 * med")
_put("future_dates", lambda s, d: quality.counts(S.table(s, d, "orders"), n_future=F.col("o_orderdate") > F.lit("2001-01-01").cast("timestamp_ntz")), "SELECT count(*) AS n_rows, count(*) FILTER (o_orderdate > TIMESTAMP '2001-01-01') AS n_future FROM orders")
_put("delivery_delay", lambda s, d: quality.delivery_delays(S.sales(s, d, ("o_orderdate",)), "o_orderdate", "l_shipdate"), f"SELECT count(*) AS n_rows, count(*) FILTER (l_shipdate < o_orderdate) AS n_before, count(*) FILTER (date_diff('day', o_orderdate, l_shipdate) > 365) AS n_late FROM {S.SQL}")
_off = "abs(l_extendedprice - {x}) / nullif(abs({x}), 0) > 0.02"
_p = "(l_quantity * p_retailprice)"
_put("amount_mismatch", lambda s, d: quality.amount_mismatch(S.sales(s, d, ("p_retailprice",)), "l_extendedprice", "l_quantity", "p_retailprice", "l_discount"), f"SELECT *, least(n_plain, n_discounted) AS n_off FROM (SELECT count(*) AS n_rows, count(*) FILTER ({_off.format(x=_p)}) AS n_plain, count(*) FILTER ({_off.format(x=f'({_p} * (1 - l_discount))')}) AS n_discounted FROM {S.SQL})")
_put("order_total_mismatch", lambda s, d: quality.order_totals(S.sales(s, d, ("o_totalprice",)), "l_orderkey", "o_totalprice", "l_extendedprice"), f"SELECT l_orderkey, n FROM (SELECT l_orderkey, any_value(o_totalprice) AS total, sum(l_extendedprice) AS lines, count(*) AS n FROM {S.SQL} GROUP BY 1) WHERE abs(total - lines) / nullif(abs(lines), 0) > 0.02")
_TEXT = "SELECT o_orderkey, concat(replace(cast(cast(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)), '.', ','), ' €') AS t FROM {t}"
_put("clean_numeric", lambda s, d: s.sql(_TEXT.format(t="{t}"), t=S.table(s, d, "orders")).select("o_orderkey", X.numeric_text(F.col("t"), True).alias("value")), "SELECT o_orderkey, round(o_totalprice, 2) AS value FROM orders")


def _comma_role(s, d):
    r = s.sql(_TEXT.format(t="{t}"), t=S.table(s, d, "orders")).agg(*X.comma_evidence(F.col("t"))).first()
    return s.createDataFrame([(*r, *X.comma_decision(*r))], "n_tail long, n_zero_first long, n_groups long, n_comma_point long, role string, confidence double")


_put("comma_role", _comma_role, "SELECT *, 'decimal' AS role, 1.0::DOUBLE AS confidence FROM (SELECT count(*) FILTER (regexp_matches(t, ',(\\d{1,2}|\\d{4,})$')) AS n_tail, count(*) FILTER (regexp_matches(t, '^-?0,\\d+$')) AS n_zero_first, count(*) FILTER (regexp_matches(t, '^-?\\d{1,3}(,\\d{3}){2,}$')) AS n_groups, count(*) FILTER (regexp_matches(t, ',\\d{3}\\.\\d+')) AS n_comma_point FROM (SELECT replace(t, ' €', '') AS t FROM (" + _TEXT.format(t="orders") + ")))")
_put("date_order", lambda s, d: S.table(s, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("t")).agg(*X.day_first_evidence(F.col("t"))), "SELECT count(*) AS n_dates, count(*) FILTER (day(o_orderdate) > 12) AS n_day_first, 0::BIGINT AS n_month_first FROM orders")
_put("parse_dates", lambda s, d: S.table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("t")).select("o_orderkey", F.date_format(X.parsed_date(F.col("t"), ("d/M/yyyy", "yyyy-M-d", "M-d-yy")), "yyyy-MM-dd").alias("day")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
_put("derive_revenue", lambda s, d: mapping.derive(S.sales(s, d, ("p_retailprice",)), "product", ("l_quantity", "p_retailprice"), "revenue").select("l_orderkey", "l_linenumber", "revenue"), f"SELECT l_orderkey, l_linenumber, round(l_quantity * p_retailprice, 2) AS revenue FROM {S.SQL}")
_put("clean_whitespace", lambda s, d: Cleaner(dirty(s, d), "o_orderkey", "amount", "day", decisions={"C01_whitespace": "trim"}).result().groupBy("priority").agg(F.count(F.lit(1)).alias("n")), f"SELECT {_trim.format(c='priority')} AS priority, count(*) AS n FROM {_D} GROUP BY 1")
_put("clean_null_placeholders", lambda s, d: Cleaner(dirty(s, d), "o_orderkey", "amount", "day", decisions={"C05_null_placeholders": "null"}).result().groupBy("remark").agg(F.count(F.lit(1)).alias("n")), f"SELECT CASE WHEN NOT {_missing} THEN remark END AS remark, count(*) AS n FROM {_D} GROUP BY 1")
_put("clean_case_variants", lambda s, d: Cleaner(dirty(s, d), "o_orderkey", "amount", "day", decisions={"C01_whitespace": "trim", "C02_case_variants": "merge"}).result().groupBy("priority").agg(F.count(F.lit(1)).alias("n")), "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
_clean = lambda s, d: Cleaner(dirty(s, d), "o_orderkey", "amount", "day", status="status", decisions={"X02_cancelled_orders": "separate", "M01_negative": "separate", "M02_zero_values": "exclude"}).result()
_C = f"(SELECT * FROM {_D} WHERE NOT {_cancelled} AND amount > 0)"
_put("clean_rows", lambda s, d: _r(_clean(s, d).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amount").alias("amount")), 2), f"SELECT count(*) AS n_rows, round(sum(amount), 2) AS amount FROM {_C}")
_put("plausibility", lambda s, d: _r(plausibility(dirty(s, d), _clean(s, d), "amount", "o_custkey").select("rows_before", "rows_after", "customers_before", "customers_after", "rows_lost", "amount_lost", "customers_lost"), 6), f"SELECT b.n AS rows_before, a.n AS rows_after, b.c AS customers_before, a.c AS customers_after, round(1 - a.n / b.n, 6) AS rows_lost, round(1 - a.s / b.s, 6) AS amount_lost, round(1 - a.c / b.c, 6) AS customers_lost FROM (SELECT count(*) AS n, sum(amount) AS s, count(DISTINCT o_custkey) AS c FROM {_D}) b, (SELECT count(*) AS n, sum(amount) AS s, count(DISTINCT o_custkey) AS c FROM {_C}) a")
_put("lost_categories", lambda s, d: lost_categories(dirty(s, d), _clean(s, d), "status"), f"SELECT DISTINCT lower(status) AS status FROM {_D} WHERE status NOT IN (SELECT status FROM {_C})")
_put("plausibility_status", lambda s, d: plausibility(dirty(s, d), _clean(s, d), "amount", "o_custkey", "day", "status").select("categories_lost", "status"), f"SELECT count(DISTINCT lower(status)) AS categories_lost, 'attention' AS status FROM {_D} WHERE status NOT IN (SELECT status FROM {_C})")

_MAPPING = {"customer_id": "o_custkey", "order_date": "day", "revenue": "amount", "order_status": "status"}


def _issues(s, d):
    df = dirty(s, d)
    columns, values = profile.profiled(df)
    issues = quality.diagnose(df, _MAPPING, "o_orderkey", "2001-01-01", columns, values=values)
    return df, [p for p in columns if p.name != "o_orderkey"], issues


def _score(s, d):
    df, columns, issues = _issues(s, d)
    value = quality.table_score(df, issues, columns)
    return s.createDataFrame([(round(value, 1), quality.label(value))], "score double, label string")


def _issue_sql():
    one = lambda id_, names, k, rest="": f"SELECT '{id_}' AS id, '{quality.RULES[id_][0]}' AS severity, '{quality.RULES[id_][1]}' AS policy, '{names}' AS columns, ({k})::BIGINT AS n_affected, {rest or '0'} AS least"
    count = lambda where: f"SELECT count(*) FROM {_D} WHERE {where}"
    parts = [one("S07_total_rows", "", count(f"{_plain('remark')} IN {_lit(X.TOTAL_TOKENS)}")), one("X01_test_rows", "", count("regexp_matches(lower(remark), '(^|[^\\p{L}\\p{N}_])(" + "|".join(X.TEST_TOKENS) + ")([^\\p{L}\\p{N}_]|$)')"))]
    parts += [one("T03_future_dates", "day", count("day > TIMESTAMP '2001-01-01'")), one("T04_absurd_dates", "day", count("year(day) < 1990")), one("M01_negative", "amount", count("amount < 0")), one("M02_zero_values", "amount", count("amount = 0"), "0.01 * (SELECT count(*) FROM orders)")]
    parts += [one("C01_whitespace", c, count(f"{c} <> {_trim.format(c=c)}")) for c in ("priority", "remark", "status")] + [one("C05_null_placeholders", "remark", count(f"remark IS NOT NULL AND {_missing}"))]
    parts += [one("C02_case_variants", c, "SELECT sum(n) FROM (" + _VAR.format(c=_trim.format(c=c), k=f"lower({_trim.format(c=c)})", t=_D) + ") WHERE spelling <> best") for c in ("priority", "remark", "status")]
    parts += [one("N03_moderate_missing", "remark", count(_missing), "0.05 * (SELECT count(*) FROM orders)"), one("X02_cancelled_orders", "status", count(_cancelled)), one("R06_cancelled_with_amount", "status,amount", count(f"{_plain('status')} IN {_lit(X.CANCELLED)} AND amount > 0"), "0.01 * (SELECT count(*) FROM orders)")]
    parts += [one("M03_extreme_outliers", c, f"SELECT count(*) FROM (SELECT *, 0.6745 * abs({c} - med) / nullif(median(abs({c} - med)) OVER (), 0) AS z FROM (SELECT *, median({c}) OVER () AS med FROM {_D})) WHERE z > 10 AND abs({c}) > 20 * med") for c in ("amount",)]
    parts += [one("D01_exact_duplicates", "", f"SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {_D} GROUP BY o_custkey, priority, remark, status, amount, day)"), one("D03_near_duplicates", "o_custkey,day,amount", f"SELECT sum(n - 1) FROM (SELECT count(DISTINCT concat_ws('|', priority, remark, status)) AS n FROM {_D} GROUP BY o_custkey, day, amount)")]
    parts += [one("X03_internal_orders", "o_custkey", f"SELECT max(n) FROM (SELECT count(*) AS n FROM {_D} GROUP BY o_custkey)", "0.05 * (SELECT count(*) FROM orders) - 0.5")]
    return "SELECT id, severity, policy, columns, n_affected FROM (" + " UNION ALL ".join(parts) + ") WHERE n_affected > least"


_put("quality_issues", lambda s, d: quality.issues_frame(s, _issues(s, d)[2]), _issue_sql())
_SHARES = ", ".join("1 - least(1.0, coalesce(sum(n_affected) FILTER (id IN " + _lit(ids) + f"), 0) / (SELECT count(*) FROM orders)) AS {k}" for k, ids in quality.SHARES.items())
_PENALTIES = "CASE " + " ".join(f"WHEN policy = '{p}' AND severity = '{v}' THEN {k}" for (p, v), k in quality.PENALTY.items()) + " ELSE 0 END"
_put("quality_score", _score, f"WITH i AS ({_issue_sql()}), x AS (SELECT {_SHARES}, coalesce(sum({_PENALTIES}), 0) AS penalty, 1 - (SELECT count(*) FILTER {_missing} / count(*) FROM {_D}) / 6 AS completeness FROM i), v AS (SELECT greatest(0, least(100, 100 * (completeness + consistency + validity + uniqueness) / 4 - penalty)) AS score FROM x) SELECT round(score, 1)::DOUBLE AS score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 55 THEN 'fair' WHEN score >= 30 THEN 'poor' ELSE 'critical' END AS label FROM v".replace("FILTER (remark", "FILTER (WHERE remark"))


_SHOWN = {
    "S07_total_rows": f"{_plain('remark')} IN {_lit(X.TOTAL_TOKENS)}", "M01_negative": "amount < 0", "M02_zero_values": "amount = 0", "X02_cancelled_orders": _cancelled, "C05_null_placeholders": f"remark IS NOT NULL AND {_missing}",
    "N03_moderate_missing": _missing, "T03_future_dates": "day > TIMESTAMP '2001-01-01'",
}


def _samples(s, d):
    found = quality.details_frame(s, _issues(s, d)[2]).where(F.col("id").isin(*_SHOWN))
    return found.select("id", F.explode("samples").alias("sample")).select("id", F.col("sample").cast("long").alias("sample"))


_put("issue_samples", _samples, " UNION ALL ".join(f"SELECT '{k}' AS id, o_orderkey AS sample FROM (SELECT o_orderkey FROM {_D} WHERE {w} ORDER BY 1 LIMIT 10)" for k, w in _SHOWN.items()))
_LOGGED = {"X02_cancelled_orders": "exclude", "D01_exact_duplicates": "remove_duplicates", "C01_whitespace": "trim", "C05_null_placeholders": "null", "C02_case_variants": "merge", "M01_negative": "exclude", "M02_zero_values": "exclude"}


def _log(s, d):
    c = Cleaner(dirty(s, d), "o_orderkey", "amount", "day", status="status", decisions=dict(_LOGGED))
    return s.createDataFrame([(e.issue, e.before, e.after, e.changed) for e in c.entries()], "issue string, n_before long, n_after long, n_changed long")


_STAYS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, priority, remark, status, amount, day ORDER BY o_orderkey) AS place FROM {_D} WHERE NOT {_cancelled}) WHERE place = 1)"
_n = lambda where="true", what="count(*)": f"(SELECT {what} FROM {_STAYS} WHERE {where})"
_padded = "coalesce(sum(" + " + ".join(f"({c} <> {_trim.format(c=c)})::BIGINT" for c in ("priority", "remark", "status")) + "), 0)"
_merged = f"SELECT coalesce(sum(n), 0) FROM ({_VAR.format(c=_trim.format(c='priority'), k='lower(' + _trim.format(c='priority') + ')', t=_STAYS)}) WHERE spelling <> best"
_put("clean_log", _log, " UNION ALL ".join(f"SELECT '{k}' AS issue, ({a})::BIGINT AS n_before, ({b})::BIGINT AS n_after, ({c})::BIGINT AS n_changed" for k, a, b, c in (
    ("X02_cancelled_orders", f"SELECT count(*) FROM {_D}", f"SELECT count(*) FROM {_D} WHERE NOT {_cancelled}", "0"), ("D01_exact_duplicates", f"SELECT count(*) FROM {_D} WHERE NOT {_cancelled}", _n(), "0"),
    ("C01_whitespace", _n(), _n(), _n(what=_padded)), ("C05_null_placeholders", _n(), _n(), _n(f"remark IS NOT NULL AND {_missing}")), ("C02_case_variants", _n(), _n(), _merged), ("M00_to_numeric", _n(), _n(), "0"),
    ("M01_negative", _n(), _n("amount >= 0"), "0"), ("M02_zero_values", _n("amount >= 0"), _n("amount > 0"), "0"), ("T00_parse_dates", _n("amount > 0"), _n("amount > 0"), "0"))))
#: More labels than a category may have, of one word each, with typing errors made from them.
_WORD = "concat(replace(p_name, ' ', ''), translate(CAST(p_partkey % 97 AS VARCHAR(20)), '0123456789', 'abcdefghij'))"
_NAMES = f"SELECT CASE WHEN p_partkey % 3 = 0 THEN substr({_WORD}, 2) WHEN p_partkey % 3 = 1 THEN concat(substr({_WORD}, 1, 4), 'x', substr({_WORD}, 5)) ELSE {_WORD} END AS label FROM {{t}} UNION ALL SELECT {_WORD} FROM {{t}}"
_put("near_labels_large", lambda s, d: quality.near_labels(s.sql(_NAMES.replace("{t}", "{p}"), p=S.table(s, d, "part")), "label", 10**9).select("a", "b", "distance"), "WITH w AS (SELECT DISTINCT label FROM (" + _NAMES.format(t="part") + ")), p AS (SELECT a.label AS a, b.label AS b, levenshtein(lower(a.label), lower(b.label)) AS distance FROM w a JOIN w b ON a.label < b.label AND abs(length(a.label) - length(b.label)) <= 2) SELECT a, b, distance::INT AS distance FROM p WHERE distance = 1 OR (distance = 2 AND least(length(a), length(b)) >= 8)")
