"""Detectors, profiles, cleaning steps, scans and reports on small hand-made tables."""

import datetime as dt
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallymark.functions import text as X
from tallymark.operators import execute, profile, quality, report, stats, verify
from tallymark.operators.clean import Cleaner
from tallymark.plans import mapping
from tallymark.plans.spec import Dimension, Filter, Spec, validate
from tallymark.sources import scan as S

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(("a", "b", "found"), [("mens wear", "womens wear", False), ("pack 12 pieces", "pack 24 pieces", False), ("South Region", "North Region", False), ("Accessory", "Accesory", True), ("Beauty care", "Beauti care", True), ("Men's Wear", "Women's Wear", False), ("Telephone", "Telefone", True), ("Electronics", "ELECTRONICS", False)])
def test_labels_that_look_like_typing_errors(spark, a, b, found):
    df = spark.createDataFrame([(a,)] * 3 + [(b,)] * 2, "c string")
    got = [(r.probable, r.variant, r.n) for r in quality.near_labels(df, "c").collect()]
    assert got == ([(a, b, 2)] if found else [])


def test_short_and_numeric_labels_are_no_typing_errors(spark):
    df = spark.createDataFrame([(x,) for x in ("South", "North", "Soath", "West")], "c string")
    assert quality.near_labels(df, "c").count() == 0
    assert quality.near_labels(spark.createDataFrame([("100 000 1",), ("100 000 2",)], "c string"), "c").count() == 0


@pytest.mark.parametrize(("status", "is_one"), [("Shipped - Lost in Transit", True), ("Undelivered", True), ("Chargeback", True), ("Void", True), ("avoid", False), ("Shipped - Delivered to Buyer", False), ("REMBOURSÉE", True), ("perdu", True), ("colis perdu", False), ("Shipped - Returned to Seller", True), (None, False)])
def test_statuses_without_revenue(spark, status, is_one):
    df = spark.createDataFrame([(status,)], "s string")
    assert df.select(X.is_cancelled(F.col("s"))).first()[0] is is_one


def _text_orders(spark):
    rows = []
    for k in range(120):
        day = dt.date(2024, 1 + k % 12, 13 + k % 15).strftime("%d/%m/%Y") if k % 40 else "hier"
        rows.append((k, f"C{k % 30}", day, f"{k + 1},50 €" if k % 10 else "N/A", "Beauté" if k % 3 else "Beaute", None, "x", "Livré" if k % 4 else "Annulé"))
    return spark.createDataFrame(rows, "no long, client string, date_achat string, montant string, rayon string, vide string, pareil string, statut string")


def test_profile_of_text_columns(spark):
    got = {p.name: p for p in profile.table(_text_orders(spark))}
    assert (got["date_achat"].type, got["date_achat"].role, got["date_achat"].day_order, got["date_achat"].date_format) == ("datetime", "temporal", "dayfirst", "d/M/yyyy")
    m = got["montant"]
    assert (m.type, m.role, m.decimal_comma, m.n_present, m.min, m.max, m.additive) == ("numeric", "measure", True, 108, 2.5, 120.5, True)
    assert m.currency_share == 1 and got["vide"].role == "empty" and got["pareil"].role == "constant" and got["rayon"].top == ("Beauté", "Beaute")
    found = mapping.build(mapping.facts_of(list(got.values()))).columns
    assert (found["order_date"], found["revenue"], found["customer_id"], found["order_status"]) == ("date_achat", "montant", "client", "statut")
    small = mapping.compact_profile(list(got.values()), mapping.build(mapping.facts_of(list(got.values()))))
    assert "vide" not in json.dumps(small, default=str) and small["n_rows"] == 120


def test_issues_of_text_columns(spark):
    df = _text_orders(spark)
    got = {(i.id, i.columns): i for i in quality.diagnose(df, {"order_date": "date_achat", "revenue": "montant", "customer_id": "client", "order_status": "statut"}, "no", "2024-06-01", notes=("S01_encoding",))}
    n = {k[0]: i.n_affected for k, i in got.items()}
    assert n["S05_empty_columns"] == 120 and n["S06_constant_columns"] == 120 and n["M04_currency_symbols"] == 108 and n["T01_unparsable"] == 3
    assert n["N01_critical_missing"] == 12 and n["C03_accent_variants"] == 1 and n["X02_cancelled_orders"] == 30 and n["S01_encoding"] == 0
    assert {"T03_future_dates", "R06_cancelled_with_amount"} <= n.keys() and not {"B01_no_rows", "B02_no_measure", "M07_ambiguous_decimal", "T02_ambiguous_format"} & n.keys()
    severities = [i.severity for i in got.values()]
    assert severities == sorted(severities, key=quality.SEVERITIES.index)


def test_ambiguous_numbers_and_dates(spark):
    rows = [(k, f"{k % 9 + 1},{100 + k}", f"{k % 12 + 1:02d}/{k % 11 + 1:02d}/2024") for k in range(60)]
    ids = {i.id for i in quality.diagnose(spark.createDataFrame(rows, "no long, montant string, date string"), {"revenue": "montant", "order_date": "date"}, "no", "2030-01-01")}
    assert {"M07_ambiguous_decimal", "T02_ambiguous_format"} <= ids
    few = {i.id for i in quality.diagnose(spark.createDataFrame([(1, "a"), (2, "b")], "no long, c string"), {}, "no", "2030-01-01")}
    assert {"B01_no_rows", "B02_no_measure", "B03_no_date"} <= few


def _orders(spark, **change):
    rows = []
    for k in range(200):
        r = {"no": k, "order_id": f"O{k:04d}", "customer_id": f"C{k % 50}", "date": DAY + dt.timedelta(days=k % 90), "delivered": DAY + dt.timedelta(days=k % 90 + 3), "quantity": float(1 + k % 4), "price": 10.0 + k % 20, "shipping": 2.0, "total": 0.0}
        r["amount"] = r["quantity"] * r["price"]
        r["total"] = r["amount"]
        for c, f in change.items():
            r[c] = f(k, r)
        rows.append(tuple(r.values()))
    return spark.createDataFrame(rows, "no long, order_id string, customer_id string, date timestamp_ntz, delivered timestamp_ntz, quantity double, price double, shipping double, total double, amount double")


COHERENT = {"order_id": "order_id", "customer_id": "customer_id", "order_date": "date", "delivery_date": "delivered", "quantity": "quantity", "unit_price": "price", "shipping_cost": "shipping", "order_total": "total", "revenue": "amount"}


@pytest.fixture(scope="module")
def clean(spark):
    return {i.id for i in quality.diagnose(_orders(spark), COHERENT, "no", "2030-01-01")}


@pytest.mark.parametrize(("id_", "n", "change"), [
    ("R01_amount_mismatch", 20, {"amount": lambda k, r: r["amount"] * (2 if k % 10 == 0 else 1)}),
    ("R02_delivery_before_order", 40, {"delivered": lambda k, r: r["date"] - dt.timedelta(days=2) if k % 5 == 0 else r["delivered"]}),
    ("R03_delivery_delay", 20, {"delivered": lambda k, r: r["date"] + dt.timedelta(days=400) if k % 10 == 0 else r["delivered"]}),
    ("R04_total_mismatch", 25, {"total": lambda k, r: r["amount"] + (90 if k % 8 == 0 else 0)}),
    ("R07_shipping_exceeds_amount", 10, {"shipping": lambda k, r: 3 * r["amount"] if k % 20 == 0 else 2.0}),
    ("D02_multiline_orders", 200, {"order_id": lambda k, r: f"O{k // 2}"}),
    ("X03_internal_orders", 101, {"customer_id": lambda k, r: "shop" if k % 2 == 0 or k == 1 else r["customer_id"]}),
    ("M03_extreme_outliers", 2, {"price": lambda k, r: 1e6 if k < 2 else r["price"]}),
    ("T06_insufficient_span", 200, {"date": lambda k, r: DAY + dt.timedelta(days=k % 30)}),
    ("D03_near_duplicates", 1, {"customer_id": lambda k, r: "C1" if k == 2 else r["customer_id"], "date": lambda k, r: DAY if k in (1, 2) else r["date"], "amount": lambda k, r: 7.77 if k in (1, 2) else r["amount"]}),
])
def test_issues_of_amounts_dates_and_orders(spark, clean, id_, n, change):
    assert id_ not in clean
    got = {i.id: i.n_affected for i in quality.diagnose(_orders(spark, **change), COHERENT, "no", "2030-01-01")}
    assert got[id_] == n


def test_whole_copies_and_implied_prices(spark):
    df = _orders(spark)
    twice = df.unionByName(df.where("no < 15").withColumn("no", F.col("no") + 1000))
    got = {i.id: i.n_affected for i in quality.diagnose(twice, COHERENT, "no", "2030-01-01")}
    assert got["D01_exact_duplicates"] == 15 and got["D02_id_duplicates"] == 15 and "D03_near_duplicates" not in got
    odd = _orders(spark, amount=lambda k, r: r["quantity"] * (1e5 if k < 3 else r["price"]))
    without = {k: v for k, v in COHERENT.items() if k != "unit_price"}
    assert {i.id: i.n_affected for i in quality.diagnose(odd, without, "no", "2030-01-01")}["R05_implied_price_outlier"] == 3


def test_row_hash_tells_where_nulls_stand(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "a"), (3, "a", None), (4, None, None)], "k int, x string, y string")
    assert [r.k for r in quality.exact_duplicates(df, "k").collect()] == [3]


def test_cleaning_reads_numbers_and_dates(spark):
    df = _text_orders(spark)
    c = Cleaner(df, "no", "montant", "date_achat", "statut", customer="client", columns=profile.table(df)).set_decision("C03_accent_variants", "merge").set_decision("N01_critical_missing", "exclude")
    got = c.result()
    assert dict(got.dtypes)["montant"] == "double" and dict(got.dtypes)["date_achat"] == "timestamp_ntz"
    assert {r.rayon for r in got.select("rayon").distinct().collect()} == {"Beauté"} and got.where("montant IS NULL OR date_achat IS NULL").count() == 0
    log = c.marked_log()
    assert log == c.marked_log() and len({x[3] for x in log}) > 1 and log[-1][0] == "N01_critical_missing"
    assert "vide" not in Cleaner(df, "no", "montant", "date_achat").apply_defaults().result().columns
    with pytest.raises(ValueError, match="no choice"):
        c.set_decision("C03_accent_variants", "explode")
    assert "unknown" not in c.set_decision("unknown", "x").decisions


def test_cleaning_merges_typing_errors_and_drops_a_shop(spark):
    rows = [(k, "Accessory" if k % 3 else "Accesory", 10.0, DAY, "shop" if k % 2 else f"c{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "no long, c string, m double, d timestamp_ntz, who string")
    c = Cleaner(df, "no", "m", "d", customer="who").set_decision("C04_near_duplicates", "merge").set_decision("X03_internal_orders", "exclude")
    got = c.result()
    assert got.count() == 30 and {r.c for r in got.collect()} == {"Accessory"}
    assert c.undo("X03_internal_orders").result().count() == 60


def _file(tmp_path, data, name="in.csv"):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def test_rows_like_the_header_are_data(spark, tmp_path):
    text = "Export;;\nville;prix;note\nThiès;1;a\nExport;;\nville;prix;note\nDakar;2;b\n"
    df, report_ = S.scan(spark, _file(tmp_path, text.encode()))
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("Thiès", "1", "a"), ("Export", None, None), ("ville", "prix", "note"), ("Dakar", "2", "b")], key=str)
    assert report_.header_row == 1 and report_.notes == ["S02_separator", "S04_header_offset"]


def test_headers_of_each_file_leave(spark, tmp_path):
    for k in range(3):
        _file(tmp_path, f"a,b\n{k},x\na,b\n".encode(), f"f{k}.csv")
    df, _ = S.scan(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("0", "x"), ("1", "x"), ("2", "x"), ("a", "b"), ("a", "b"), ("a", "b")]


def test_line_breaks_in_cells(spark, tmp_path):
    df, report_ = S.scan(spark, _file(tmp_path, b'a,b\n1,"two\nlines"\n2,"say ""hi"""\n'))
    assert report_.line_breaks_in_cells and sorted(map(tuple, df.collect())) == [("1", "two\nlines"), ("2", 'say "hi"')]


def test_encodings_over_all_lines(spark, tmp_path):
    late = "ville,prix\n" + "Dakar,1\n" * 300 + "Thiès,2€\n"
    df, report_ = S.scan(spark, _file(tmp_path, late.encode("cp1252")))
    assert report_.encoding == "windows-1252" and df.where("ville = 'Thiès' AND prix = '2€'").count() == 1
    odd, report_ = S.scan(spark, _file(tmp_path, b"ville,prix\nThi\xe8s\x81,2\n", "odd.csv"))
    assert report_.encoding == "latin-1" and odd.first().ville == "Thiès\x81"


def test_bytes_sheets_views_and_types(spark, tmp_path):
    df, _ = S.read_any(spark, "ville;prix\nThiès;1\n".encode("cp1252"), "upload.csv")
    assert [tuple(r) for r in df.collect()] == [("Thiès", "1")]
    sheet, found = S.from_rows(spark, [["Ventes", "", ""], ["", "", ""], ["date", "prix", "prix"], ["x", "1", ""], ["y"]])
    assert found.columns == ["date", "prix", "prix_2"] and [tuple(r) for r in sheet.collect()] == [("x", "1", None), ("y", None, None)]
    with pytest.raises(ValueError, match="zipped XML|B04"):
        S.read_any(spark, b"PK", "book.xlsx")
    typed = S.read_typed(spark, _file(tmp_path, b"d,x\n2024-01-02,3\nno,4\n"), "d date, x int")
    assert {tuple(r) for r in typed.collect()} == {(dt.date(2024, 1, 2), 3), (None, 4)}
    assert S.view(typed, "typed_rows").count() == spark.sql("SELECT * FROM typed_rows").count()
    assert [tuple(r) for r in S.described(typed).collect()] == [(0, "d", "date"), (1, "x", "int")]
    S.write_csv(typed, f"{tmp_path}/out")
    S.write_csv(typed, f"{tmp_path}/out", append=True)
    assert S.scan(spark, f"{tmp_path}/out")[0].count() == 4


@pytest.mark.parametrize(("text", "values"), [("1 234 567,8 puis 1.234,56", [1234567.8, 1234.56]), ("1,234,567 et 2.345.678", [1234567.0, 2345678.0]), ("en 2024 500 ventes", [2024.0, 500.0]), ("12,5% (+3)", [12.5, 3.0]), ("v1.2.3", [123.0]), ("12 34 567", [12.0, 34567.0]), ("−1 000,", [-1000.0])])
def test_runs_of_digits(spark, text, values):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    assert [r.value for r in verify.numbers(df, "id", "t").orderBy("position").collect()] == values


def test_overall_fidelity(spark):
    rows = [(1, "verified"), (1, "ignored"), (2, "verified"), (2, "unverified"), (3, "ignored")]
    r = verify.overall(spark.createDataFrame(rows, "report long, status string")).first()
    assert (r.n_reports, r.n_named, r.n_verified, r.n_unverified, r.n_faithful, r.fidelity) == (3, 5, 2, 1, 2, pytest.approx(2 / 3))


def test_all_groups_are_shown_without_a_limit(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("c"), F.lit(1.0).alias("m"))
    d = execute.with_totals(df, Spec("m", "sum", (Dimension("c"),)))
    assert d.count() == 3000 and d.where("n_groups = 3000 AND total = 3000").count() == 3000
    assert execute.with_totals(df, Spec("m", "sum", (Dimension("c"),), limit=7)).count() == 7


def test_medians_of_groups(spark):
    rows = [(k % 7 if k % 50 else None, None if k % 11 == 0 else ((k * 7919) % 1000) / 7 - 50) for k in range(900)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = dict(con.execute("SELECT g, median(x) FROM t GROUP BY g").fetchall())
    got = {r.g: r.m for r in stats.exact_medians(spark.createDataFrame(rows, "g int, x double"), ["g"], "x").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_a_plan_runs_on_after_a_failure(spark):
    df = _orders(spark)
    month = Spec("amount", "sum", (Dimension("date", "temporal", "month"),), title="by month")
    specs = [month, Spec("absent", "sum", (Dimension("date", "temporal", "month"),), title="bad"), Spec("amount", "sum", (Dimension("quantity"),), title="one", filters=()), Spec("amount", "sum", (Dimension("shipping"),), title="single")]
    got = report.run_plan(df, specs, COHERENT)
    assert [s.title for s, _ in got.done] == ["by month", "one"] and {s.title: w[:2] for s, w in got.failed}["single"] == "V9" and {s.title for s, _ in got.failed} == {"bad", "single"}
    p = report.perimeter(df.where("no < 150"), "amount", "date", df).first()
    body = json.loads(report.export(got, p, "€"))
    assert body["perimeter"]["n_rows"] == 150 and "150 commandes analysées sur 200 reçues" in body["perimeter"]["sentence"] and len(body["analyses"]) == 2 and len(body["failed"]) == 2
    more = report.perimeter(df.where("no < 150").withColumn("amount", F.col("amount") * 9), "amount", "date", df).first()
    assert "retours" in report.sentence(more)


@pytest.mark.parametrize(("keep", "status"), [("no >= 0", "ok"), ("no >= 6", "modified"), ("no >= 100", "attention"), ("quantity <> 4 OR no < 0", "attention")])
def test_plausibility(spark, keep, status):
    df = _orders(spark).withColumn("kind", F.concat(F.lit("k"), F.col("quantity").cast("string")))
    assert report.plausibility(df, df.where(keep), "amount", "customer_id", "date", "kind").first().status == status


def test_charts_and_extremes(spark):
    columns = {"m": {"role": "measure", "additive": True}, "c": {"role": "categorical", "n_unique": 5}, "d": {"role": "temporal", "type": "datetime"}}
    chart = lambda kind, *dims: validate(Spec("m", "sum", dims, chart=kind), columns)[0].chart
    assert [chart("line", Dimension("c")), chart("area", Dimension("c"), Dimension("d", "temporal")), chart("pie", Dimension("c")), chart("scatter", Dimension("c")), chart("treemap", Dimension("c"))] == ["bar", "area", "bar", "bar", "treemap"]
    agg = spark.createDataFrame([("b", 5.0, 1), ("a", 5.0, 1), ("c", 1.0, 1), ("d", 1.0, 1)], "dim0 string, value double, n_rows long")
    assert tuple(stats.extremes(agg).first()) == ("a", "c")


def test_compact_numbers(spark):
    df = spark.createDataFrame([(1234567.0,), (45600.0,), (12.0,)], "x double")
    assert [r[0] for r in df.select(X.compact(F.col("x"))).collect()] == ["1.2M", "46k", "12"]


def test_copies_of_one_row(spark):
    """One row copied many times, null keys and near copies, against windows over all rows."""
    rows = [(k, "same" if k < 3000 else f"x{k % 7}" if k % 3 else None, k % 2 if k >= 3000 else 0, k % 5 if k >= 3500 else 0) for k in range(4000)]
    df = spark.createDataFrame(rows, "id int, a string, b int, c int")
    exact, near = [], []
    seen_row, seen_key = set(), set()
    for r in rows:
        if r[1:] in seen_row:
            exact.append(r)
        elif r[1:3] in seen_key:
            near.append(r)
        seen_row.add(r[1:])
        seen_key.add(r[1:3])
    assert sorted(map(tuple, quality.exact_duplicates(df, "id").collect())) == exact
    assert sorted(map(tuple, quality.near_duplicates(df, ["a", "b"], "id").collect())) == near
    assert sorted(map(tuple, quality.one_of_each(df, ["a", "b"], "id").collect())) == sorted(r for r in rows if r not in set(exact) | set(near))
    for d in (quality.exact_duplicates(df, "id"), quality.near_duplicates(df, ["a", "b"], "id")):
        assert "Window" not in d._jdf.queryExecution().executedPlan().toString()


def test_pareto_by_brute_force(spark):
    for values in ([5.0] * 50, [0.0] * 9, [1.0, -1.0, 3.0, -3.0], [-2.0, -2.0, -5.0, -1.0], [10.0] * 5, [4.0, 4.0, 1.0, -3.0, -3.0, 0.0, 0.0], [7.0, 1.0], [1e-3 * k for k in range(600)]):
        agg = spark.createDataFrame([(f"g{k:04}", v, 1) for k, v in enumerate(values)], "dim0 string, value double, n_rows long")
        r, down, total = stats.pareto(agg).first(), sorted(values, reverse=True), sum(values)
        assert r.n_groups == len(values)
        if len(values) < 3 or not total:
            assert (r.top20_share_pct, r.top1_share_pct, r.n_for_80pct) == (None, None, None)
            continue
        assert r.top20_share_pct == pytest.approx(100 * sum(down[: max(1, len(down) // 5)]) / total) and r.top1_share_pct == pytest.approx(100 * down[0] / total)
        assert r.n_for_80pct == sum(sum(down[: k + 1]) / total <= 0.8 for k in range(len(down))) + 1, values


def test_short_series_have_no_trend(spark):
    agg = lambda n: spark.createDataFrame([(f"2020-0{k}", float(k), 5) for k in range(1, n + 1)], "dim0 string, value double, n_rows long")
    two, three = stats.trend(agg(2)).first(), stats.trend(agg(3)).first()
    assert (two.first_value, two.change_pct, two.slope, two.r2, two.direction) == (None,) * 5
    assert three.slope == pytest.approx(1.0) and three.direction == "hausse"


def test_all_specs_of_a_plan_from_one_scan(spark):
    rows = [(f"k{k % 5}" if k % 9 else None, f"c{k % 3}", float(k % 17) if k % 13 else None, k % 40) for k in range(900)]
    df = spark.createDataFrame(rows, "a string, b string, x double, who int")
    d = Dimension
    specs = [Spec("x", how, (d("a"),), title=how) for how in ("sum", "mean", "median", "count", "min", "max", "std")]
    specs += [Spec("who", "count_distinct", (d("a"), d("b")), title="who"), Spec("x", "median", (d("b"),), (Filter("a", "eq", "k1"),), title="f"), Spec("who", "sum", (d("x", "numeric_binned", bins=4),), title="bins"), Spec("x", "sum", (d("a"),), (Filter("x", "gt", 3), Filter("absent", "eq", 1)), title="gt")]
    parts = execute.aggregated(df, specs)
    key = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    for k, s in enumerate(specs):
        got, want = execute.of_spec(parts, specs, k), execute.grouped(df, s)
        assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.collect())), s.title
        assert tuple(execute.coverage_of(parts, k).first()) == tuple(execute.coverage(df, s).first()), s.title
    plan = execute.aggregated(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), [Spec("o_totalprice", h, (d("o_orderpriority"),)) for h in ("sum", "median", "std")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "o_comment" not in plan


def test_profiles_read_the_table_once(spark, tmp_path):
    rows = [(k, f"v{k % 4}" if k % 5 else "N/A", float(k % 7), f"{k % 28 + 1:02d}/03/2024", "y" * 2000 + str(k % 2)) for k in range(200)]
    spark.createDataFrame(rows, "id int, kind string, amount double, day string, long_text string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    columns, values = profile.profiled(df)
    by = {p.name: p for p in columns}
    assert (by["kind"].n_unique, by["kind"].n_present, by["kind"].role, by["long_text"].n_unique, by["amount"].median) == (4, 160, "categorical", 2, 3.0)
    assert by["day"].type == "datetime" and by["long_text"].top and len(by["long_text"].top[0]) == 2001
    assert values.groupBy("c").count().count() == 5
    assert profile.table(df.limit(0))[0].n == 0


def test_issue_details_and_first_rows(spark):
    rows = [(k, "Paris" if k % 4 else "paris", -5.0 if k % 10 == 0 else 20.0 + k % 3, "annulé" if k % 8 == 0 else "livré", f"C{k % 30}") for k in range(120)]
    df = spark.createDataFrame(rows, "no int, city string, amount double, status string, who string")
    found = {i.id: i for i in quality.diagnose(df, {"revenue": "amount", "order_status": "status", "customer_id": "who"}, "no", "2030-01-01")}
    assert found["M01_negative"].samples == tuple(range(0, 100, 10)) and found["M01_negative"].details == {"total": -60.0}
    assert found["X02_cancelled_orders"].samples == tuple(range(0, 80, 8)) and found["X02_cancelled_orders"].details == {"statuses": ["annulé"]}
    assert found["X02_cancelled_orders"].options == ("separate", "exclude", "keep")
    assert found["C02_case_variants"].details == {"groups": {"Paris": ["Paris", "paris"]}} and found["C02_case_variants"].samples == tuple(range(0, 40, 4))
    shown = {r.id: r for r in quality.details_frame(spark, list(found.values())).collect()}
    assert shown["M01_negative"].samples[:2] == ["0", "10"] and json.loads(shown["C02_case_variants"].details)["groups"]


def test_log_of_a_replay_is_that_of_its_steps(spark):
    rows = [(k, [" Paris", "paris", "Paris", "Lyon", "Lyn"][k % 5], -1.0 if k % 11 == 0 else 0.0 if k % 13 == 0 else 1e6 if k == 77 else 10.0 + k % 4, "annulé" if k % 17 == 0 else "livré", "2024-01-01") for k in range(200)]
    rows += [(1000 + k, *rows[k][1:]) for k in range(50)]
    df = spark.createDataFrame(rows, "no int, city string, amount double, status string, day string")
    choose = {"X02_cancelled_orders": "exclude", "D01_exact_duplicates": "remove", "D02_id_duplicates": "remove_duplicates", "C01_whitespace": "trim", "C02_case_variants": "merge", "C04_near_duplicates": "merge", "M03_extreme_outliers": "exclude", "M01_negative": "exclude", "M02_zero_values": "exclude", "N01_critical_missing": "exclude"}
    c = Cleaner(df, "no", "amount", "day", "status", decisions=dict(choose))
    got = c.entries()
    d, want = df, []
    for name, step in c.steps():
        what = step(d)
        after = c._applied(d, what)
        a = {r.no: r for r in d.collect()}
        b = {r.no: r for r in after.collect()}
        want.append((name, len(a), len(b), sum(str(a[k][x]) != str(b[k][x]) for k in b for x in b[k].asDict() if not (name == "T00_parse_dates" and x == "day")) + (len(b) if name == "T00_parse_dates" else 0)))
        d = after
    assert [(e.issue, e.before, e.after, e.changed) for e in got] == want and len({e.mark for e in got}) > 5
    assert sorted(r.no for r in c.result().collect()) == sorted(b)
    with pytest.raises(ValueError, match="no step"):
        c.set_decision("T06_insufficient_span", "exclude")


def test_many_labels_by_brute_force(spark):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcde") for _ in range(rnd.choice((4, 7, 8, 12, 39, 44, 60)))) for _ in range(150)]

    def edited(s: str) -> str:
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(s) + 1)
            s = rnd.choice((s[:k] + rnd.choice("abcde") + s[k:], s[:k] + s[k + 1 :], s[:k] + rnd.choice("abcde") + s[k + 1 :]))
        return s

    labels = sorted({*base, *map(edited, base), *map(edited, base)})

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :] if abs(len(a) - len(b)) <= 2 and (1 == (d := distance(a, b)) or d == 2 and min(len(a), len(b)) >= 8)}
    got = quality.near_labels(spark.createDataFrame([(x,) for x in labels], "c string"), "c", 10**6)
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 100
