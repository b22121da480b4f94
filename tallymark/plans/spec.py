"""The analysis spec: one measure, one or two dimensions, filters, sort, limit; and the rules it must meet."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

# Fixed values of the grammar.
AGGREGATIONS = ("sum", "mean", "median", "count", "count_distinct", "min", "max", "std")
DIMENSION_TYPES = ("temporal", "categorical", "numeric_binned")
GRAINS = ("day", "week", "month", "quarter", "year", "dayofweek", "hour")
FILTER_OPS = ("eq", "neq", "in", "not_in", "gt", "gte", "lt", "lte", "between", "not_null")
CHARTS = ("line", "bar", "grouped_bar", "stacked_bar", "area", "scatter", "heatmap", "histogram", "boxplot", "treemap")


@dataclass(frozen=True)
class Dimension:
    column: str
    type: str = "categorical"
    grain: str | None = None
    bins: int = 10


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Spec:
    column: str
    aggregation: str
    dimensions: tuple[Dimension, ...]
    filters: tuple[Filter, ...] = ()
    sort_by: str | None = None
    descending: bool | None = None
    limit: int | None = None
    chart: str = "bar"
    title: str = ""
    origin: str = "guaranteed"


@dataclass
class Validated:
    specs: list[Spec] = field(default_factory=list)
    rejected: list[tuple[Spec, str]] = field(default_factory=list)
    changes: list[str] = field(default_factory=list)


def validate(spec: Spec, columns: dict[str, dict], present=None) -> tuple[Spec | None, list[str]]:
    """The spec as it may run and what was changed, or None and why not.

    ``columns`` has role, additive, n_unique and type by column name;
    ``present(column, values)`` tells which of some filter values occur.
    """
    notes: list[str] = []
    if spec.aggregation not in AGGREGATIONS or not 1 <= len(spec.dimensions) <= 2:
        return None, ["V0 shape"]
    if any(d.type not in DIMENSION_TYPES or d.grain not in (None, *GRAINS) for d in spec.dimensions):
        return None, ["V0 dimension"]
    if spec.column not in columns or any(d.column not in columns for d in spec.dimensions):
        return None, ["V1 column"]
    measure = columns[spec.column]
    if spec.aggregation == "sum" and measure.get("additive") is False and measure["role"] != "identifier":
        spec, notes = replace(spec, aggregation="mean"), [*notes, "V2 sum to mean"]
    if measure["role"] == "identifier" and spec.aggregation not in ("count", "count_distinct"):
        spec, notes = replace(spec, aggregation="count_distinct"), [*notes, "V3 identifier to count_distinct"]
    elif measure["role"] not in ("measure", "identifier") and spec.aggregation not in ("count", "count_distinct"):
        return None, ["V3 not a measure"]
    dims = []
    for d in spec.dimensions:
        if d.type == "temporal":
            if columns[d.column].get("type") != "datetime":
                return None, ["V4 not a date"]
            if d.grain is None:
                d, notes = replace(d, grain="month"), [*notes, "V4 month"]
        dims.append(d)
    spec = replace(spec, dimensions=tuple(dims))
    if dims[0].type == "categorical" and columns[dims[0].column].get("n_unique", 0) > 50 and not spec.limit:
        spec, notes = replace(spec, limit=15), [*notes, "V5 limit 15"]
    if spec.chart not in CHARTS or spec.chart in ("line", "area") and not any(d.type == "temporal" for d in dims):
        spec, notes = replace(spec, chart="bar"), [*notes, "V6 bar"]
    if spec.chart == "scatter" and len(dims) < 2:
        spec, notes = replace(spec, chart="bar"), [*notes, "V7 bar"]
    filters = []
    for f in spec.filters:
        if f.column not in columns or f.op not in FILTER_OPS:
            notes.append(f"V10 filter on {f.column} dropped")
            continue
        if f.op in ("eq", "in") and present is not None:
            values = [f.value] if f.op == "eq" else list(f.value)
            kept = present(f.column, values)
            if not kept:
                notes.append(f"V10 no value of {f.column} occurs")
                continue
            if len(kept) < len(values):
                notes.append(f"V10 values of {f.column} dropped")
            f = replace(f, value=kept[0] if f.op == "eq" else tuple(kept))
        filters.append(f)
    spec = replace(spec, filters=tuple(filters))
    if spec.sort_by is None:
        temporal = dims[0].type == "temporal"
        spec = replace(spec, sort_by="dimension" if temporal else "measure", descending=not temporal)
    return spec, notes


def signature(spec: Spec) -> tuple:
    """What makes two specs the same analysis; sort and limit don't."""
    return spec.column, spec.aggregation, tuple((d.column, d.grain) for d in spec.dimensions), tuple(sorted((f.column, f.op, str(f.value)) for f in spec.filters))


def validate_plan(specs: list[Spec], columns: dict[str, dict], present=None, most: int = 8, least_external: int = 3) -> Validated:
    """Valid specs once each: external ones keep at least ``least_external`` of ``most`` places, guaranteed ones take the rest."""
    out, seen, good = Validated(), set(), []
    for s in specs:
        v, notes = validate(s, columns, present)
        out.changes += notes if v else []
        if v is None:
            out.rejected.append((s, notes[0]))
        elif signature(v) in seen:
            out.rejected.append((s, "V8 duplicate"))
        else:
            seen.add(signature(v))
            good.append(v)
    own = [s for s in good if s.origin == "guaranteed"]
    external = [s for s in good if s.origin != "guaranteed"]
    n = min(len(external), max(least_external, most - len(own)))
    out.specs = own[: most - n] + external[:n]
    return out


def guaranteed(mapping: dict[str, str]) -> list[Spec]:
    """The analyses that the mapped concepts allow."""
    date = Dimension(mapping["order_date"], "temporal", "month")
    money = mapping["revenue"]
    out = [Spec(money, "sum", (date,), chart="line", title="revenue by month")]
    if c := mapping.get("product_category"):
        out.append(Spec(money, "sum", (Dimension(c),), limit=15, title="revenue by category"))
    out.append(Spec(money, "mean", (date,), chart="line", title="mean revenue by month"))
    out.append(Spec(money, "sum", (replace(date, grain="dayofweek"),), title="revenue by day of the week"))
    if c := mapping.get("product_id"):
        out.append(Spec(money, "sum", (Dimension(c),), limit=15, title="revenue by product"))
    if c := mapping.get("region"):
        out.append(Spec(money, "sum", (Dimension(c),), limit=12, title="revenue by region"))
    if c := mapping.get("customer_id"):
        out.append(Spec(c, "count_distinct", (date,), chart="line", title="customers by month"))
    return out
