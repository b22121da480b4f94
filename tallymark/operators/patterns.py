"""Business patterns of an aggregate (dim0, value, n_rows), each a condition on its statistics.

A rule returns at most one row: pattern_id, confidence, evidence (JSON).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.operators import stats
from tallymark.plans.spec import Spec

CYCLIC = ("dayofweek", "hour")
#: What may lie behind a pattern, and what a shop can do about it.
NOTES = {
    "trend_decline": (("demande en recul", "prix ou concurrence"), ("comparer les produits qui reculent", "relancer les clients inactifs")),
    "trend_growth": (("demande en hausse", "nouveaux clients"), ("vérifier les stocks", "soutenir les produits qui progressent")),
    "anomaly_spike": (("opération commerciale", "grosse commande ou double saisie"), ("vérifier les commandes de la période",)),
    "pareto_concentration": (("quelques lignes font l'essentiel des ventes",), ("protéger les meilleures ventes", "réduire la dépendance")),
    "geographic_concentration": (("clientèle d'une seule zone",), ("essayer une zone voisine",)),
    "long_tail_dead_stock": (("références qui ne se vendent presque pas",), ("écouler ou retirer ces références",)),
    "day_of_week_peak": (("habitudes d'achat de la semaine",), ("placer envois et équipes sur ces jours",)),
    "seasonal_peak": (("saison ou fêtes",), ("préparer les stocks avant la période",)),
    "basket_erosion": (("articles moins chers ou remises",), ("proposer des lots", "revoir les remises")),
    "single_purchase_dominance": (("peu de clients reviennent",), ("écrire aux clients après l'achat",)),
}


def _found(d: DataFrame, name: str, confidence: float | Column, **evidence: Column) -> DataFrame:
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return d.select(F.lit(name).alias("pattern_id"), sure.alias("confidence"), F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()])).alias("evidence"))


def trend(agg: DataFrame) -> DataFrame:
    t = stats.trend(agg).where("n >= 4 AND r2 > 0.25 AND direction <> 'stable' AND abs(slope) > 0.02 * mean")
    name = F.when(F.col("direction") == "baisse", "trend_decline").otherwise("trend_growth")
    return t.select(name.alias("pattern_id"), F.least(F.lit(0.95), F.col("r2") + 0.3).alias("confidence"), F.to_json(F.struct("slope", "r2", "change_pct")).alias("evidence"))


def spike(agg: DataFrame) -> DataFrame:
    """Lone high points by the median deviation: at most two, or a fifth of all points."""
    d = stats.with_robust_z(agg).withColumn("n", F.count(F.lit(1)).over(W.partitionBy())).where("n >= 4")
    d = d.agg(F.max("n").alias("n"), F.count_if((F.col("z") > 3.5) & (F.col("value") > F.col("med"))).alias("n_spikes"), F.max("value").alias("top"), F.max("med").alias("usual"))
    return _found(d.where(F.col("n_spikes").between(1, F.greatest(F.lit(2), F.floor(F.col("n") / 5)))), "anomaly_spike", 0.8, n_spikes=F.col("n_spikes"), top=F.col("top"), usual=F.col("usual"))


def pareto(agg: DataFrame) -> DataFrame:
    d = stats.pareto(agg).where("n_groups >= 4 AND top20_share_pct >= 75")
    return _found(d, "pareto_concentration", 0.9, top20_share_pct=F.col("top20_share_pct"), top1_share_pct=F.col("top1_share_pct"), n_for_80pct=F.col("n_for_80pct"))


def geographic(agg: DataFrame) -> DataFrame:
    d = agg.agg(F.count(F.lit(1)).alias("n"), (F.try_divide(F.max("value"), F.sum("value")) * 100).alias("share"), F.max_by("dim0", "value").alias("zone"))
    return _found(d.where("n >= 2 AND share >= 50"), "geographic_concentration", 0.85, zone=F.col("zone"), share_pct=F.col("share"), n_zones=F.col("n"))


def long_tail(agg: DataFrame) -> DataFrame:
    return _found(stats.long_tail(agg).where("found"), "long_tail_dead_stock", 0.75, n_small=F.col("n_small"), n_groups=F.col("n_groups"))


def weekday_peak(agg: DataFrame, factor: float = 1.4) -> DataFrame:
    d = agg.withColumn("mean", F.avg("value").over(W.partitionBy()))
    d = d.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("value") >= factor * F.col("mean"), F.col("dim0")))).alias("days"), F.min_by("dim0", F.struct("value", "dim0")).alias("low"))
    return _found(d.where((F.col("n") >= 5) & (F.size("days") > 0)), "day_of_week_peak", 0.85, days=F.col("days"), low=F.col("low"))


def seasonal_peak(agg: DataFrame, factor: float = 1.8) -> DataFrame:
    d = agg.withColumn("mid", F.median("value").over(W.partitionBy()))
    d = d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= factor * F.col("mid")).alias("n_peaks"), F.max("mid").alias("mid"))
    return _found(d.where((F.col("n") >= 8) & F.col("n_peaks").between(1, F.floor(F.col("n") / 3))), "seasonal_peak", 0.8, n_peaks=F.col("n_peaks"), median=F.col("mid"))


def basket_erosion(agg: DataFrame) -> DataFrame:
    d = stats.trend(agg).where("n >= 3 AND change_pct < -10 AND direction = 'baisse'")
    return _found(d, "basket_erosion", 0.8, change_pct=F.col("change_pct"), first=F.col("first_value"), last=F.col("last_value"))


def orders_per_customer(df: DataFrame, order: str, customer: str) -> DataFrame:
    """One row: distinct orders, distinct customers, and orders over customers (null without customers)."""
    return df.agg(F.count_distinct(order).alias("orders"), F.count_distinct(customer).alias("customers")).withColumn("ratio", F.try_divide("orders", "customers"))


def single_purchase(df: DataFrame, order: str, customer: str, below: float = 1.3) -> DataFrame:
    d = orders_per_customer(df, order, customer)
    return _found(d.where(F.col("ratio") < below), "single_purchase_dominance", 0.85, orders=F.col("orders"), customers=F.col("customers"), orders_per_customer=F.round("ratio", 2))


def with_notes(found: DataFrame) -> DataFrame:
    """Adds the causes and actions that belong to a pattern."""
    for k, name in enumerate(("causes", "actions")):
        cases = F.coalesce(*[F.when(F.col("pattern_id") == p, F.array(*map(F.lit, notes[k]))) for p, notes in NOTES.items()])
        found = found.withColumn(name, cases)
    return found


def detect(agg: DataFrame, spec: Spec, *, role: str | None = None, source: DataFrame | None = None, order: str | None = None, customer: str | None = None) -> DataFrame:
    """All patterns that the spec's kind of aggregate may show. ``role`` is the measure's, or ``region`` for an axis of regions."""
    dim = spec.dimensions[0]
    if dim.type == "temporal":
        grain = dim.grain or "month"
        out = [] if grain in CYCLIC else [trend(agg), spike(agg)]
        if grain == "dayofweek":
            out.append(weekday_peak(agg))
        if grain == "month":
            out.append(seasonal_peak(agg))
        if spec.aggregation == "mean" and role == "revenue" and grain not in CYCLIC:
            out.append(basket_erosion(agg))
        if spec.aggregation == "count_distinct" and role == "customer_id" and source is not None and order and customer:
            out.append(single_purchase(source, order, customer))
    else:
        out = [pareto(agg), long_tail(agg)] + ([geographic(agg)] if role == "region" else [])
    return reduce(DataFrame.unionByName, out) if out else _found(agg.limit(0), "none", 0.0, none=F.lit(None).cast("string"))
