"""Number checks, sectors, mapping, patterns, facts and the stream on small hand-made tables."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tallymark.operators import facts, patterns, profile, quality, sector, stats, verify
from tallymark.plans import mapping
from tallymark.plans.mapping import ColumnFacts
from tallymark.plans.spec import Dimension, Spec
from tallymark.streaming import daily_rollup


def test_numbers(spark):
    text = "CA de 1 234,56 € (−66,8 %) contre 4820.56 le 2024-12-31, soit 1,234.56 ou 1058 ; période 2024-12."
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "sans nombre"), (1, "7")], "id long, t string")
    got = verify.numbers(rows, "id", "t").orderBy("report", "position").collect()
    assert sorted(r.value for r in got if r.report == 1) == sorted([1234.56, -66.8, 4820.56, 1234.56, 1058.0, 7.0])
    assert {r.report for r in got} == {1}
    masked = re.sub(r"\b\d{4}-\d{2}(-\d{2})?\b", lambda m: "·" * len(m[0]), text)
    for r in got:
        if r.value != 7.0:
            assert masked[r.position :].startswith(r.number) and r.number in r.context


def test_number_spaces(spark):
    d = spark.createDataFrame([(1, "1 234 567 et 12 500,5")], "id long, t string")
    assert sorted(r.value for r in verify.numbers(d, "id", "t").collect()) == [12500.5, 1234567.0]


def test_verified_is_brute_force(spark):
    named = [-66.8, 66.8, 67.0, 1058.0, 1063.3, 1063.4, 3.0, 2024.0, 0.5, 99999.0]
    known = [("a", -66.8), ("b", 1058.0), ("c", 0.5025), ("d", 0.0)]
    found = spark.createDataFrame([(1, k, str(v), v, "x") for k, v in enumerate(named)], "report long, position long, number string, value double, context string")
    table = spark.createDataFrame([(1, p, v) for p, v in known] + [(2, "z", 99999.0)], "report long, path string, value double")
    got = {r.value: r.status for r in verify.verified(found, table).collect()}
    refs = [x for _, v in known for x in (v, abs(v), float(round(v)))]

    def expected(v):
        if v in verify.SMALL_NUMBERS or 1900 <= v <= 2100 and v % 1 == 0:
            return "ignored"
        return "verified" if any(abs(v - r) <= 0.005 * abs(r) for r in refs) else "unverified"

    assert got == {v: expected(v) for v in named}
    f = verify.fidelity(verify.verified(found, table)).first()
    assert f.n_named == len(named) and f.n_ignored == 2


def test_duration_is_ignored(spark):
    d = spark.createDataFrame([(1, "sur 12 mois"), (2, "12 clients")], "id long, t string")
    none = spark.createDataFrame([], "report long, path string, value double")
    assert {r.report: r.status for r in verify.verified(verify.numbers(d, "id", "t"), none).collect()} == {1: "ignored", 2: "unverified"}


def test_amounts_that_look_like_years(spark, tmp_path):
    """Whole amounts that look like years or small numbers are ignored, as the query's SQL has them; checked only where cents are asked to count."""
    import duckdb

    from tallymark.report_queries import ORACLE_SQL, QUERIES

    amounts = [2000.0, 1900.0, 2100.0, 1050.0, 100.0, 10.0, 5.0, 0.5, 1234.56, 1000.0, 2000.0, 0.0, None, -3.0, -2000.0, 950.0]
    spark.createDataFrame([(k if k else 20, v) for k, v in enumerate(amounts)], "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("verify_numbers", "fidelity"):
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLE_SQL[name]).fetchall())
    d = spark.createDataFrame([(1, "en 2000, 2 000,00 puis 2,000.00 et 2000.0")], "id long, t string")
    none = spark.createDataFrame([], "report long, path string, value double")
    why = lambda **o: [r.why for r in verify.verified(verify.numbers(d, "id", "t"), none, **o).orderBy("position").collect()]
    assert why() == ["year"] * 4 and why(cents_count=True) == ["year", None, None, "year"]


def test_words(spark):
    d = spark.createDataFrame([("Une médiane et le p-value", "Comparez vos prix moyens"), ("clair", "Autre chose")], "t string, a string")
    got = d.select(verify.jargon(F.col("t")).alias("j"), verify.derived_action(F.col("a"), F.lit("Comparer les prix moyens du marché")).alias("ok")).collect()
    assert [(r.j, r.ok) for r in got] == [(["médiane", "p-value"], True), ([], False)]


def test_labels_and_sector(spark):
    d = spark.createDataFrame([("Robe rouge",)] * 4 + [("Chemise",)] * 2 + [("85123A",), ("REF-001",), ("12",), (None,), ("Perceuse 500 W",)], "p string")
    assert {r.label for r in sector.labels(d, "p").collect()} == {"Robe rouge", "Chemise", "Perceuse 500 W"}
    r = sector.sector(sector.labels(d, "p")).first()
    assert (r.sector, r.to_confirm) == (None, True) or r.confidence >= 0.35
    only = sector.sector(sector.labels(d.where("p LIKE 'R%' OR p LIKE 'C%'"), "p")).first()
    assert (only.sector, only.confidence) == ("mode", 0.6)
    assert sector.sector(sector.labels(d.where("p IS NULL"), "p")).count() == 0


WHOLESALE = [
    ColumnFacts("Invoice", "identifier", 500, 0.95), ColumnFacts("StockCode", "high_cardinality_cat", 300, 0.3), ColumnFacts("Quantity", "measure", 722, 0.1, 1, 900, 3.0),
    ColumnFacts("InvoiceDate", "temporal", 400, 0.8), ColumnFacts("Price", "measure", 200, 0.2, 0.1, 500.0, 2.5), ColumnFacts("Country", "categorical", 40, 0.01),
]


def test_mapping_price_beside_quantity():
    m = mapping.build(WHOLESALE)
    assert m.columns["unit_price"] == "Price" and "revenue" not in m.columns
    assert m.missing_required == ["revenue"] and mapping.questions(m)[0] == ("revenue", "high", None)
    assert mapping.derivations(m) == [("product", ("Quantity", "Price"))]
    assert "geographic_split" not in m.analyses and "revenue" in m.unavailable["geographic_split"]


def test_mapping_keeps_item_sequence_out_of_quantity():
    m = mapping.build([ColumnFacts("order_item_id", "measure", 20, 0.01, 1, 20, 1.0), ColumnFacts("price", "measure", 900, 0.4, 1.0, 900.0, 75.0), ColumnFacts("order_purchase_timestamp", "temporal")])
    assert m.columns["revenue"] == "price" and "quantity" not in m.columns


@pytest.mark.parametrize(("name", "concept", "least", "most"), [("Status", "order_status", 1.15, 1.15), ("Courier Status", "order_status", 0.9, 0.9), ("date livraison", "order_date", 0, 0.5), ("Qté", "quantity", 1.15, 1.15), ("zzz", "revenue", 0, 0)])
def test_name_scores(name, concept, least, most):
    assert least <= mapping.name_score(name, concept) <= most


def test_mapping_fallback_and_cleaning():
    m = mapping.build([ColumnFacts("quand", "temporal"), ColumnFacts("combien", "measure", 90, 0.5, 1.0, 90.0, 5.0), ColumnFacts("vide", "empty")])
    assert m.columns["order_date"] == "quand" and m.columns["revenue"] == "combien" and set(m.low_confidence) == {"order_date", "revenue"}
    after = mapping.after_cleaning(m, [ColumnFacts("combien", "measure", 90, 0.5, 1.0, 90.0, 5.0)])
    assert after.columns == {"revenue": "combien"} and after.missing_required == ["order_date"]
    assert mapping.build([]).missing_required == ["order_date", "revenue"]


def test_derive(spark):
    d = spark.createDataFrame([("2", "1.255"), ("x", "3"), (None, "1")], "q string, p string")
    assert [r.amount for r in mapping.derive(d, "product", ("q", "p"), "amount").collect()] == [2.51, None, None]


def test_text_types(spark):
    d = spark.createDataFrame([("1,5", "oui", "04/10/2023", "N/A"), ("2", "non", "31/12/2023", "-"), (None, "oui", "1/1/2024", "")], "a string, b string, c string, d string")
    assert {r.column: (r.type, r.n) for r in profile.text_types(d, d.columns).collect()} == {"a": ("text", 2), "b": ("boolean", 3), "c": ("datetime", 3), "d": ("text", 0)}


def _agg(spark, values, names=None):
    return spark.createDataFrame([(names[k] if names else f"2024-{k + 1:02d}", float(v), 10) for k, v in enumerate(values)], "dim0 string, value double, n_rows long")


MONTHLY = Spec("x", "sum", (Dimension("d", "temporal", "month"),))


def test_patterns(spark):
    found = lambda agg, spec=MONTHLY, **k: {r.pattern_id for r in patterns.detect(agg, spec, **k).collect()}
    assert found(_agg(spark, [10, 20, 30, 40, 50, 60])) == {"trend_growth"}
    assert found(_agg(spark, [60, 50, 40, 30, 20, 15])) == {"trend_decline"}
    assert found(_agg(spark, [10] * 8)) == set()
    assert "anomaly_spike" in found(_agg(spark, [10, 11, 10, 9, 10, 90, 11, 10]))
    flat = Spec("x", "sum", (Dimension("d"),))
    assert found(_agg(spark, [90, 5, 5], ["a", "b", "c"]), flat, role="region") == {"geographic_concentration"}
    assert found(_agg(spark, [9000, 5, 5, 5, 5], list("abcde")), flat) == {"pareto_concentration", "long_tail_dead_stock"}
    week = Spec("x", "sum", (Dimension("d", "temporal", "dayofweek"),))
    assert found(_agg(spark, [10, 10, 10, 10, 30], ["lundi", "mardi", "jeudi", "vendredi", "samedi"]), week) == {"day_of_week_peak"}


def test_single_purchase_reads_all_orders(spark, tmp_path):
    from tallymark.report_queries import QUERIES

    def found(name, rows):
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        return [(r.pattern_id, r.confidence) for r in QUERIES["pattern_single_purchase"](spark, f"{tmp_path}/{name}").collect()]

    assert found("ten_each", [(k, k % 41) for k in range(410)]) == []
    assert found("one_each", [(k, k % 33) for k in range(1, 40)]) == [("single_purchase_dominance", 0.85)]
    d = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 3), (5, 4)], "o long, c long")
    assert json.loads(patterns.single_purchase(d, "o", "c").first().evidence) == {"orders": 5, "customers": 4, "orders_per_customer": 1.25}


def test_facts_of_many_groups_are_bounded(spark):
    """Month by customer: every month kept is one of the last, and the customers are the largest."""
    d = spark.range(20_000).select(F.date_add(F.lit("2015-01-01").cast("date"), (F.col("id") % 3000).cast("int")).alias("day"), (F.col("id") % 700).cast("string").alias("who"), (F.col("id") % 700 + 1.0).alias("x"))
    row = facts.facts(d, Spec("x", "sum", (Dimension("day", "temporal", "month"), Dimension("who")), title="t")).first()
    points = json.loads(row.facts)["data_points"]
    assert row.n_groups > 5000 and len({p["dim0"] for p in points}) <= facts.SHOWN[0] and len({p["dim1"] for p in points}) <= facts.SHOWN[1]
    assert min(p["dim0"] for p in points) >= "2019-02" and {p["dim1"] for p in points} <= {str(k) for k in range(680, 700)}  # the last fifty months


def test_facts(spark):
    d = spark.createDataFrame([(m, float(k + 1)) for k, m in enumerate("abcab")], "k string, x double")
    row = facts.facts(d, Spec("x", "sum", (Dimension("k"),), title="t")).first()
    body = json.loads(row.facts)
    assert row.n_groups == 3 and body["coverage"]["n_rows"] == 5 and {p["dim0"]: p["value"] for p in body["data_points"]} == {"a": 5.0, "b": 7.0, "c": 3.0}
    assert facts.facts(d.where("k = 'a'"), Spec("x", "sum", (Dimension("k"),))).count() == 0
    assert facts.chart_spec(Spec("x", "sum", (Dimension("k"),), chart="treemap"))["kind"] == "bar"


@pytest.mark.parametrize("n", [1, 30, 31, 100, 400])
def test_sampled_points(spark, n):
    got = [r.dim0 for r in facts.sampled_points(_agg(spark, range(n), [f"{k:04d}" for k in range(n)])).orderBy("dim0").collect()]
    names = [f"{k:04d}" for k in range(n)]
    assert got == (names if n <= 30 else [names[0], *names[1:-1][:: n // 28][:28], names[-1]])


def test_rollup_ignores_the_session_zone(spark):
    d = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 23:30:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT TIMESTAMP_NTZ '2024-01-02 00:30:00', 'a', 2.0D")
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(r.day for r in daily_rollup(d).collect()) == ["2024-01-01", "2024-01-02"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


@pytest.mark.parametrize("values", [[], [5.0], [1.0, 2.0], [1.0] * 9 + [7.0], [-3.0, -2.5, 0.0, 0.001, 1e12, -1e12, None, float("nan")], [k * 0.37 - 40 for k in range(301)], [2.0] * 50 + [3.0] * 50])
def test_exact_median(spark, values):
    d = spark.createDataFrame([(v,) for v in values], "x double")
    known = sorted(v for v in values if v is not None and v == v)
    want = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if known else None
    assert stats.exact_median(d, "x").first().m == want


def test_pareto_with_ties_and_negatives(spark):
    values = [50.0, 50.0, 20.0, 20.0, 20.0, 1.0, 0.0, -2.0, 7.0, 7.0]
    r = stats.pareto(_agg(spark, values, list("abcdefghij"))).first()
    total, down = sum(values), sorted(values, reverse=True)
    assert (r.n_groups, r.n_for_80pct) == (10, sum(sum(down[: k + 1]) / total <= 0.8 for k in range(10)) + 1)
    assert abs(r.top20_share_pct - 100 * sum(down[:2]) / total) < 1e-9


def test_sampling_error_of_all_rows_is_zero(spark):
    d = spark.createDataFrame([(k, k % 3) for k in range(30)], "a int, b int")
    assert {r.column: (r.exact, r.error) for r in profile.sampling_error(d, ["a", "b"], 1.0).collect()} == {"a": (1.0, 0.0), "b": (0.1, 0.0)}


def test_table_score(spark):
    d = spark.createDataFrame([("x",), ("N/A",), ("y",), ("z",)], "a string")
    assert quality.table_score(d, []) == 93.75
    issue = quality.Issue("D01_exact_duplicates", "high", "ASK", (), 2)
    assert quality.table_score(d, [issue]) == 93.75 - 12.5 - 9 and quality.label(72.25) == "fair"


def test_updates_of_a_stream_are_merged(spark, tmp_path):
    """Files that come one a batch, with days that several of them touch, give what one read gives."""
    from tallymark.sources.scan import scratch_folder
    from tallymark.streaming import daily_rollup, run_daily_rollup

    rows = spark.range(300).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 5 AS INT), cast(id % 24 AS INT))").alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    got = run_daily_rollup(spark, f"{tmp_path}/events.parquet", scratch_folder(spark), "update", 1)
    want = daily_rollup(spark.read.parquet(f"{tmp_path}/events.parquet"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 15


def test_lexicon_as_a_table(spark):
    names = spark.createDataFrame([("Robe d'été rouge",), ("robes longues",), ("Lampe",), ("",), (None,)], "label string")
    words = {"mode": ("robe", "jupe"), "maison": ("lampe",), "accent": ("ete",)}
    table = spark.createDataFrame([(s, w) for s, ws in words.items() for w in ws] + [("mode", "ROBE "), ("none", "")], "sector string, word string")
    of = lambda lexicon: {(r.sector, r.score, tuple(r.words)) for r in sector.scores(names, lexicon).collect()}
    assert of(table) == of(words) == {("mode", 2, ("robe",)), ("maison", 1, ("lampe",)), ("accent", 1, ("ete",))}
