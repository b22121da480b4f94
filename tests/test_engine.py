"""Cases that once went wrong in such engines, on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymark.functions import text as X
from tallymark.operators import quality, stats
from tallymark.operators.clean import Cleaner
from tallymark.operators.execute import execute, filtered
from tallymark.operators.profile import role
from tallymark.plans.spec import Dimension, Filter, Spec, guaranteed, validate, validate_plan
from tallymark.sources.sales import MAPPING

COLUMNS = {"m": {"role": "measure", "additive": True}, "p": {"role": "measure", "additive": False}, "k": {"role": "identifier"}, "d": {"role": "temporal", "type": "datetime"}, "c": {"role": "categorical", "n_unique": 90}}


def _series(spark, values, rows=None):
    return spark.createDataFrame([(f"2024-{i + 1:02d}", float(v), (rows or [10] * len(values))[i]) for i, v in enumerate(values)], "dim0 string, value double, n_rows long")


def test_rules_of_specs():
    month = (Dimension("d", "temporal"),)
    assert validate(Spec("p", "sum", month), COLUMNS)[0].aggregation == "mean"
    assert validate(Spec("k", "sum", month), COLUMNS)[0].aggregation == "count_distinct"
    assert validate(Spec("m", "sum", month), COLUMNS)[0].dimensions[0].grain == "month"
    assert validate(Spec("m", "sum", (Dimension("c"),)), COLUMNS)[0].limit == 15
    assert validate(Spec("c", "sum", month), COLUMNS)[0] is None
    assert validate(Spec("m", "sum", (Dimension("absent"),)), COLUMNS)[0] is None
    assert validate(Spec("m", "avg", month), COLUMNS)[0] is None
    kept = validate(Spec("m", "sum", month, (Filter("c", "in", ("a", "z")),)), COLUMNS, lambda c, v: [x for x in v if x == "a"])[0]
    assert kept.filters == (Filter("c", "in", ("a",)),)


def test_plan_without_duplicates():
    s = Spec("m", "sum", (Dimension("d", "temporal", "month"),))
    out = validate_plan([s, Spec("m", "sum", (Dimension("d", "temporal"),), limit=3)], COLUMNS)
    assert len(out.specs) == 1 and out.rejected[0][1] == "V8 duplicate"
    assert len(guaranteed(MAPPING)) == 7


def test_both_edges_partial(spark):
    agg = _series(spark, [1, 100, 98, 96, 94, 2])
    assert [r.dim0 for r in stats.marked_edges(agg).where("partial").collect()] == ["2024-01", "2024-06"]
    t = stats.trend(agg).first()
    assert t.first_value == 100 and t.last_value == 94 and t.direction == "baisse"


def test_constant_series_has_no_fit(spark):
    t = stats.trend(_series(spark, [5, 5, 5, 5])).first()
    assert t.r2 == 0 and t.direction == "stable"


def test_null_keys_and_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 9.0)], "c string, m double")
    assert {(r.dim0, r.value, r.n_rows) for r in execute(df, Spec("m", "sum", (Dimension("c"),))).collect()} == {("a", 1.0, 2), ("b", 0.0, 1)}
    assert [r.dim0 for r in execute(df, Spec("m", "mean", (Dimension("c"),))).collect()] == ["a"]
    rows, used = filtered(df, (Filter("c", "neq", "a"), Filter("zz", "eq", 1)))
    assert rows.count() == 2 and len(used) == 1
    assert execute(df.limit(0), Spec("m", "sum", (Dimension("c"),))).count() == 0


@pytest.mark.parametrize(("text", "comma", "want"), [("1.234,56 €", True, 1234.56), ("1,234.56", False, 1234.56), ("4820.56", False, 4820.56), ("1d", False, None), ("NaN", False, None), ("", True, None), (None, True, None)])
def test_numbers_from_text(spark, text, comma, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.numeric_text(F.col("t"), comma)).first()[0] == want


def test_dates(spark):
    df = spark.createDataFrame([("04-30-22",), ("4/10/2023",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(X.parsed_date(F.col("t"), ("d/M/yyyy", "M-d-yy"))).collect()]
    assert got == [dt.datetime(2022, 4, 30), dt.datetime(2023, 10, 4), None, None]


def test_cancelled_statuses(spark):
    df = spark.createDataFrame([("Annulé",), ("Shipped - Rejected by Buyer",), ("Livré",), (None,)], "s string")
    assert [r[0] for r in df.select(X.is_cancelled(F.col("s"))).collect()] == [True, True, False, False]


def test_labels_that_are_not_typos(spark):
    df = spark.createDataFrame([("South",), ("North",), ("Accessory",), ("Accesory",)], "c string")
    assert [(r.a, r.b) for r in quality.near_labels(df, "c").collect()] == [("Accesory", "Accessory")]


def _raw(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, " Web ", 12.0, day, "Livré"), (2, "web", 10.0, day, "Livré"), (3, "Web", -5.0, day, "Livré"), (4, "Web", 0.0, day, "Livré"), (5, "TOTAL", 99.0, day, "Livré"), (6, "Web", 7.0, day, "Annulé"), (7, "n/a", 8.0, dt.datetime(1900, 1, 1), "Livré"), (8, "web", 10.0, day, "Livré")]
    return spark.createDataFrame(rows, "id long, c string, m double, d timestamp_ntz, s string")


def test_cleaning_is_idempotent_and_undoable(spark):
    c = Cleaner(_raw(spark), "id", "m", "d", "s").apply_defaults()
    once = c.result()
    again = Cleaner(once, "id", "m", "d", "s").apply_defaults().result()
    assert sorted(once.collect()) == sorted(again.collect())
    assert [r.id for r in c.aside["refunds"].collect()] == [3]
    c.undo("M01_negative")
    assert 3 in {r.id for r in c.result().collect()}
    assert [n for n, _, _ in c.log()][0] == "S07_total_rows"


def test_roles():
    assert role("order_id", "text", 100, 100, 90, False) == "identifier"
    assert role("amount", "numeric", 100, 100, 3, False) == "measure"
    assert role("x", "text", 100, 0, 0, False) == "empty"
    assert role("x", "text", 100, 100, 1, False) == "constant"


def test_score_of_quality():
    issues = [quality.Issue("M01_negative", "medium", "ASK", (), 3)]
    assert quality.score(1, 1, 1, 1, issues) == 95 and quality.label(95) == "excellent"
