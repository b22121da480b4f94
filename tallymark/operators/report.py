"""Runs a whole plan, says what it covers, and judges what cleaning changed."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallymark.operators import facts
from tallymark.operators.execute import aggregated, coverage_of, of_spec
from tallymark.plans.spec import Spec
from tallymark.sources.scan import written

# The change in per cent from which an indicator is an alert, and from which it is worth a word.
ALERTS = {"rows": 20.0, "amount": 15.0, "customers": 20.0, "days": 10.0}
NOTABLE = 2.0


@dataclass
class PlanResult:
    done: list[tuple[Spec, Row]] = field(default_factory=list)
    failed: list[tuple[Spec, str]] = field(default_factory=list)


def _shared(df: DataFrame, specs: list[Spec]) -> tuple[DataFrame | None, list[Spec], list[tuple[Spec, Exception]]]:
    """The specs' results from one scan, the specs that are in it, and those that can't be built; no results if the scan itself fails."""
    good: list[Spec] = []
    bad: list[tuple[Spec, Exception]] = []
    for spec in specs:
        try:
            aggregated(df, [spec]).schema  # noqa: B018  analysis finds unknown columns and types
            good.append(spec)
        except Exception as e:  # whatever a spec raises is its own failure
            bad.append((spec, e))
    if not good:
        return None, good, bad
    try:
        return written(aggregated(df, good)), good, bad
    except Exception:  # a value of one column: each spec is run by itself, and fails by itself
        return None, good, bad


def run_plan(df: DataFrame, specs: list[Spec], mapping: dict[str, str | None] | None = None) -> PlanResult:
    """Facts of each spec, or why it has none: too few groups, or the error that it raised.

    All specs are aggregated in one scan, which reads the columns that any of
    them names; their facts come from that result. A spec that fails doesn't
    stop the others: one that can't be built is left out of the scan, and if a
    value makes the scan fail, specs are run one by one. Each result is one row.
    """
    concept = {c: k for k, c in (mapping or {}).items() if c}
    out = PlanResult()
    why = lambda e: f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"
    parts, good, bad = _shared(df, specs)
    errors = {id(spec): e for spec, e in bad}
    place = {id(spec): k for k, spec in enumerate(good)}
    for spec in specs:
        if id(spec) in errors:
            out.failed.append((spec, why(errors[id(spec)])))
            continue
        more = {"role": "region" if concept.get(spec.dimensions[0].column) == "region" else concept.get(spec.column), "order": (mapping or {}).get("order_id"), "customer": (mapping or {}).get("customer_id")}
        try:
            if parts is None:
                rows = facts.facts(df, spec, **more).collect()
            else:
                k = place[id(spec)]
                rows = facts.of_aggregate(of_spec(parts, good, k), coverage_of(parts, k), spec, source=df, **more).collect()
        except Exception as e:  # as above
            out.failed.append((spec, why(e)))
            continue
        if rows:
            out.done.append((spec, rows[0]))
        else:
            out.failed.append((spec, "V9 fewer than two groups"))
    return out


def run_all(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """(spec, dim0, value, n_rows) of all specs of one dimension, from one scan, for a plan that is only read."""
    parts = written(aggregated(df, specs))
    each = [of_spec(parts, specs, k).select(F.lit(s.title).alias("spec"), "dim0", F.col("value").cast("double").alias("value"), "n_rows") for k, s in enumerate(specs)]
    return reduce(DataFrame.unionByName, each)


def export(result: PlanResult, covered: Row | None = None, unit: str = "") -> str:
    """A whole report as JSON text: its perimeter, the patterns of all analyses, each analysis, and those that failed."""
    bodies = [(spec, json.loads(row.facts)) for spec, row in result.done]
    seen = [{"analysis": spec.title, **p} for spec, body in bodies for p in body["detected_patterns"]]
    return json.dumps({
        "perimeter": covered.asDict() | {"sentence": sentence(covered, unit)} if covered else None,
        "synthesis": sorted(seen, key=lambda p: -p["confidence"]),
        "analyses": [{"title": spec.title, "chart": facts.chart_spec(spec)} | body for spec, body in bodies],
        "failed": [{"title": spec.title, "reason": why} for spec, why in result.failed],
    }, ensure_ascii=False, default=str)


def perimeter(df: DataFrame, amount: str, date: str, raw: DataFrame | None = None) -> DataFrame:
    """One row: rows, amount, first and last day and days; with ``raw`` also its rows and amount and the shares that are left."""
    def one(d: DataFrame, tail: str) -> DataFrame:
        return d.agg(F.count(F.lit(1)).alias(f"n_rows{tail}"), F.sum(amount).alias(f"amount{tail}"))

    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(amount).alias("amount"), day(F.min(date)).alias("first_day"), day(F.max(date)).alias("last_day"), F.datediff(F.max(date), F.min(date)).cast("long").alias("days"), F.count_if(F.col(amount).isNull()).alias("n_without_amount"))
    if raw is None:
        return out
    out = out.crossJoin(one(raw, "_received"))  # one row each
    share = lambda a, b: F.round(100 * F.try_divide(F.col(a), F.col(b)), 1)
    return out.withColumn("rows_pct", share("n_rows", "n_rows_received")).withColumn("amount_pct", share("amount", "amount_received"))


def sentence(p: Row, unit: str = "") -> str:
    """The perimeter in words, for the head of a report."""
    say = lambda x: f"{x:,.0f}".replace(",", " ")
    found = p.asDict()
    out = f"{say(p.n_rows)} commandes analysées"
    if found.get("n_rows_received") is not None and p.n_rows < p.n_rows_received:
        out += f" sur {say(p.n_rows_received)} reçues"
    if p.first_day:
        out += f", du {p.first_day} au {p.last_day}"
    if p.amount is not None:
        out += f". Chiffre d'affaires : {say(p.amount)} {unit}".rstrip()
        if found.get("amount_pct") is not None and p.amount_pct > 100:
            out += ", après retrait de retours et d'avoirs"
        elif found.get("amount_pct") is not None:
            out += f" ({p.amount_pct} % du total reçu)"
    if p.n_without_amount:
        out += f". {say(p.n_without_amount)} lignes sans montant ne comptent pas"
    return out + "."


def plausibility(before: DataFrame, after: DataFrame, amount: str, customer: str, date: str | None = None, category: str | None = None) -> DataFrame:
    """Rows, amounts, customers, days and categories before and after, the share that each lost, and a status.

    ``attention`` if a change passes its alert or a category is gone,
    ``modified`` if one is notable, else ``ok``.
    """
    def one(d: DataFrame, t: str) -> DataFrame:
        sums = {"rows": F.count(F.lit(1)), "amount": F.sum(amount), "customers": F.count_distinct(customer)}
        if date:
            sums["days"] = F.datediff(F.max(date), F.min(date))
        return d.agg(*[c.alias(f"{k}_{t}") for k, c in sums.items()])

    d = one(before, "before").crossJoin(one(after, "after"))  # one row each
    names = ["rows", "amount", "customers"] + (["days"] if date else [])
    d = d.withColumns({f"{k}_lost": 1 - F.col(f"{k}_after") / F.nullif(F.col(f"{k}_before"), F.lit(0)) for k in names})
    lost = lost_categories(before, after, category).agg(F.count(F.lit(1)).alias("categories_lost")) if category else None
    d = d.crossJoin(lost) if category else d.withColumn("categories_lost", F.lit(0).cast("long"))
    change = {k: F.coalesce(F.abs(F.col(f"{k}_lost")) * 100, F.lit(0.0)) for k in names}
    alerts = sum([F.when(c > ALERTS[k], 1).otherwise(0) for k, c in change.items()], F.when(F.col("categories_lost") > 0, 1).otherwise(0))
    return d.withColumn("n_alerts", alerts).withColumn("status", F.when(F.col("n_alerts") > 0, "attention").when(F.greatest(*change.values()) >= NOTABLE, "modified").otherwise("ok"))


def lost_categories(before: DataFrame, after: DataFrame, c: str) -> DataFrame:
    """Values of a category, without case and spaces, that cleaning left no row of."""
    own = lambda d: d.select(F.lower(F.trim(F.col(c).cast("string"))).alias(c)).where(F.col(c).isNotNull()).distinct()
    return own(before).join(own(after), c, "left_anti")
