"""Cleaning as an ordered list of steps, replayed from the raw table on each change of mind.

A step says which rows go, which values change or which columns go. ``result``
applies the steps one after the other; ``history`` leaves every row in place
with the number of the step that dropped it and what each step changed, so that
all counts of a replay come from one aggregate. Steps that need to know other
rows (copies, merged spellings, outliers) write what they found, ids or
spellings, to the shared folder once, so that plans don't grow with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.text import DATE_FORMATS, is_cancelled, is_null_token, numeric_text, parsed_date, trimmed
from tallymark.operators import quality
from tallymark.operators.profile import ColumnProfile
from tallymark.sources.scan import written

KEEP = ("keep", "keep_all", "keep_separate", "none", "review", "preview")
#: The order of steps is fixed: structure, rows, categories, measures, dates, missing; and what may be chosen besides keeping.
CHOICES = {
    "S05_empty_columns": ("drop",), "S06_constant_columns": ("drop",), "S07_total_rows": ("remove",), "X01_test_rows": ("exclude",), "X02_cancelled_orders": ("separate", "exclude"), "D01_exact_duplicates": ("remove_duplicates", "remove"), "D02_id_duplicates": ("remove_duplicates",),
    "D03_near_duplicates": ("remove_duplicates",), "X03_internal_orders": ("exclude",), "C01_whitespace": ("trim",), "C05_null_placeholders": ("null",), "C02_case_variants": ("merge",), "C03_accent_variants": ("merge",),
    "C04_near_duplicates": ("merge",), "M00_to_numeric": ("to_numeric",), "M03_extreme_outliers": ("exclude",), "M01_negative": ("separate", "exclude"), "M02_zero_values": ("exclude",), "T00_parse_dates": ("parse",),
    "T04_absurd_dates": ("null",), "T03_future_dates": ("exclude",), "N01_critical_missing": ("exclude",),
}
ORDER = tuple(CHOICES)
#: How leaving it is called where that isn't ``keep``.
FIRST_KEEP = {"S07_total_rows": "keep_all", "D01_exact_duplicates": "keep_all", "C03_accent_variants": "keep_separate", "C04_near_duplicates": "keep_separate", "M03_extreme_outliers": "preview", "D03_near_duplicates": "review"}
DEFAULTS = {
    "S05_empty_columns": "drop", "S07_total_rows": "remove", "X01_test_rows": "exclude", "X02_cancelled_orders": "separate", "D01_exact_duplicates": "remove_duplicates", "C01_whitespace": "trim",
    "C05_null_placeholders": "null", "C02_case_variants": "merge", "M01_negative": "separate", "M02_zero_values": "exclude", "T04_absurd_dates": "null", "N01_critical_missing": "exclude",
}


@dataclass
class Step:
    """What a step does: rows that meet ``drop`` go (or those with ids in ``gone``, or not in ``only``), values of ``sets`` change, and those of ``merged`` columns if they are in its (c, spelling, best); only ``columns`` stay."""

    name: str
    drop: Column | None = None
    gone: DataFrame | None = None
    only: DataFrame | None = None
    sets: dict[str, Column] = field(default_factory=dict)
    merged: tuple[dict[str, int], DataFrame] | None = None
    columns: list[str] | None = None
    aside: str | None = None


@dataclass(frozen=True)
class Entry:
    """A step in the log: rows before and after it, values it changed in rows that it left, and a fingerprint of the rows after it."""

    issue: str
    before: int
    after: int
    changed: int
    mark: str


@dataclass
class Cleaner:
    """Decisions by issue id over a raw table; nothing is ever imputed.

    Numbers and dates in text columns are read whatever was decided: ``columns``
    are profiles that say how, without them only ``amount`` and ``date`` are
    read, with a decimal point and by the first of the known forms.
    """

    raw: DataFrame
    row_id: str
    amount: str
    date: str
    status: str | None = None
    keys: tuple[str, ...] = ()
    as_of: str = "2100-01-01"
    customer: str | None = None
    order: str | None = None
    columns: list[ColumnProfile] = field(default_factory=list)
    decisions: dict[str, str] = field(default_factory=dict)
    aside: dict[str, DataFrame] = field(default_factory=dict)

    def apply_defaults(self) -> Cleaner:
        self.decisions = dict(DEFAULTS)
        return self

    def set_decision(self, issue: str, choice: str) -> Cleaner:
        """Unknown issues are ignored. A choice that an issue doesn't have raises ValueError, as does one other than keeping for an issue without a step."""
        if issue in CHOICES:
            if choice not in (*CHOICES[issue], *KEEP):
                raise ValueError(f"{issue} has no choice {choice}")
            self.decisions[issue] = choice
        elif issue in quality.RULES and choice not in KEEP:
            raise ValueError(f"{issue} has no step, so {choice} can't be decided")
        return self

    def undo(self, issue: str) -> Cleaner:
        self.decisions[issue] = "keep"
        return self

    def steps(self) -> list[tuple[str, Callable[[DataFrame], Step]]]:
        always = ("M00_to_numeric", "T00_parse_dates")
        named = {"C04_near_duplicates": self._near_labels}  # ends in the same words as the issue of rows
        return [(k, named.get(k) or getattr(self, "_" + k.split("_", 1)[1])) for k in ORDER if k in always or self.decisions.get(k, "keep") not in KEEP]

    def result(self) -> DataFrame:
        df = self.raw
        self.aside = {}
        for name, step in self.steps():
            what = step(df)
            what.name = name
            if what.aside and what.drop is not None:
                self.aside[what.aside] = df.where(what.drop)
            df = self._applied(df, what)
        return df

    def _applied(self, df: DataFrame, step: Step) -> DataFrame:
        names = [f"`{c}`" for c in df.columns]
        if step.drop is not None:
            df = df.where(~F.coalesce(step.drop, F.lit(False)))
        for ids, how in ((step.gone, "left_anti"), (step.only, "left_semi")):
            if ids is not None:
                df = df.join(ids, self.row_id, how).select(*names)
        df, best = self._with_best(df, step)
        if step.sets or best:
            df = df.withColumns(step.sets | best).select(*names)
        return df.select(*[f"`{c}`" for c in step.columns]) if step.columns is not None else df

    @staticmethod
    def _with_best(df: DataFrame, step: Step) -> tuple[DataFrame, dict[str, Column]]:
        """Joined with the spellings to take, and the values that merged columns then have."""
        best: dict[str, Column] = {}
        for c, k in (step.merged or ({}, None))[0].items():
            of = step.merged[1].where(F.col("c") == k).select(F.col("spelling").alias(f"__s{k}"), F.col("best").alias(f"__b{k}"))
            df = df.join(of, F.col(f"`{c}`") == F.col(f"__s{k}"), "left")
            best[c] = F.coalesce(f"__b{k}", f"`{c}`")
        return df, best

    def history(self) -> tuple[DataFrame, list[str]]:
        """Every raw row with ``__step``, the number of the step that dropped it (null if it stays), and for each step ``__v`` values changed and ``__h`` the hash of the row after it; and the steps' names."""
        raw = [f"`{c}`" for c in self.raw.columns]
        df = self.raw.select(*raw, F.lit(None).cast("int").alias("__step"))
        shown, names, extra = list(self.raw.columns), [], []
        for k, (name, step) in enumerate(self.steps()):
            here = F.col("__step").isNull()
            what = step(df.where(here).select(*[f"`{c}`" for c in shown]))
            goes = F.lit(False) if what.drop is None else F.coalesce(what.drop, F.lit(False))
            for ids, inside in ((what.gone, True), (what.only, False)):
                if ids is not None:
                    df = df.join(ids.select(F.col(f"`{self.row_id}`").alias("__id")).distinct(), F.col(f"`{self.row_id}`") == F.col("__id"), "left")
                    goes = goes | (F.col("__id").isNotNull() if inside else F.col("__id").isNull())
                    df = df.withColumn("__goes", goes)
                    goes = F.col("__goes")
                    df = df.drop("__id")
            df = df.withColumn("__step", F.when(here & goes, k).otherwise(F.col("__step"))).drop("__goes")
            df, best = self._with_best(df, what)
            sets = what.sets | best
            changed = sum([F.when(~F.col(f"`{c}`").cast("string").eqNullSafe(x.cast("string")), 1).otherwise(0) for c, x in sets.items()], F.lit(0))
            df = df.withColumn(f"__v{k}", changed).withColumns(sets)
            shown = what.columns if what.columns is not None else shown
            df = df.withColumn(f"__h{k}", quality.row_hash(shown))
            extra += [f"__v{k}", f"__h{k}"]
            names.append(name)
            df = df.select(*[f"`{c}`" for c in shown], "__step", *extra)
        return df, names

    def entries(self) -> list[Entry]:
        """The log of all steps, from one aggregate over ``history``; the order of rows doesn't matter to it."""
        df, names = self.history()
        own = [F.count(F.lit(1)).alias("n")]
        for k in range(len(names)):
            left, h = F.col("__step").isNull() | (F.col("__step") > k), f"__h{k}"
            sums = [F.coalesce(F.bit_xor(F.when(left, F.col(f"{h}.col{x}"))), F.lit(0)) for x in (1, 2)] + [F.coalesce(F.sum(F.when(left, F.col(f"{h}.col1").cast("decimal(38,0)"))), F.lit(0))]
            own.append(F.struct(F.count_if(left).alias("after"), F.coalesce(F.sum(F.when(left, F.col(f"__v{k}"))), F.lit(0)).alias("changed"), F.sha2(F.concat_ws(":", F.count_if(left), *sums), 256).alias("mark")).alias(f"s{k}"))
        r = df.agg(*own).first()
        out, before = [], r["n"]
        for k, name in enumerate(names):
            s = r[f"s{k}"]
            out.append(Entry(name, before, s.after, s.changed, s.mark))
            before = s.after
        return out

    def log(self) -> list[tuple[str, int, int]]:
        """(issue, rows before, rows after) of each step on rows and their values."""
        return [(e.issue, e.before, e.after) for e in self.entries() if e.issue not in ("S05_empty_columns", "S06_constant_columns")]

    def marked_log(self) -> list[tuple[str, int, int, str]]:
        """(issue, rows before, rows after, fingerprint of the rows after) of each step."""
        return [(e.issue, e.before, e.after, e.mark) for e in self.entries()]

    def changes(self) -> list[tuple[str, int]]:
        """(issue, values changed) of each step that may change values; numbers and dates read from text count if they read differently."""
        return [(e.issue, e.changed) for e in self.entries()]

    def _without(self, df, constant):
        known = {self.row_id, self.amount, self.date, self.status, self.customer, self.order, *self.keys}
        kept = quality.without_empty(df, constant).columns
        return Step("", columns=[c for c in df.columns if c in kept or c in known])

    def _empty_columns(self, df):
        return self._without(df, False)

    def _constant_columns(self, df):
        """No default: a column may only be constant once other rows are gone."""
        return self._without(df, True)

    def _total_rows(self, df):
        return Step("", drop=quality.total_rows(df))

    def _test_rows(self, df):
        return Step("", drop=quality.test_rows(df))

    def _cancelled_orders(self, df):
        if not self.status:
            return Step("")
        return Step("", drop=is_cancelled(F.col(f"`{self.status}`")), aside="cancelled" if self.decisions["X02_cancelled_orders"] == "separate" else None)

    def _exact_duplicates(self, df):
        rest = [c for c in df.columns if c != self.row_id]
        return Step("", only=written(quality.firsts(df, quality.row_hash(rest), self.row_id)))

    def _id_duplicates(self, df):
        """Copies of whole rows; rows that share an order's number alone are its lines and stay."""
        return self._exact_duplicates(df)

    def _near_duplicates(self, df):
        return Step("", only=written(quality.firsts(df, list(self.keys), self.row_id))) if self.keys else Step("")

    def _internal_orders(self, df):
        if not self.customer:
            return Step("")
        top = [r.value for r in quality.dominant_value(df, self.customer).collect()]  # one at most
        return Step("", drop=F.col(f"`{self.customer}`").eqNullSafe(F.lit(top[0]))) if top else Step("")

    def _texts(self, df):
        return [f.name for f in df.schema if f.dataType.simpleString() == "string"]

    def _categories(self, df):
        """Text columns that may be merged: those that profiles call categories, or all that aren't numbers or dates."""
        if self.columns:
            named = {p.name for p in self.columns if p.role in ("categorical", "boolean_flag")}
            return [c for c in self._texts(df) if c in named]
        return [c for c in self._texts(df) if c not in (self.amount, self.date)]

    def _whitespace(self, df):
        return Step("", sets={c: trimmed(F.col(f"`{c}`")) for c in self._texts(df)})

    def _null_placeholders(self, df):
        return Step("", sets={c: F.when(~is_null_token(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in self._texts(df)})

    def _merged(self, df, best_of, cell=lambda c: c):
        """Spellings of all columns from one pass; ``best_of`` gives (c, spelling, best) of those that change."""
        names = {c: k for k, c in enumerate(self._categories(df))}
        if not names:
            return Step("")
        cells = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(k).alias("c"), cell(F.col(f"`{c}`")).alias("spelling"))) for c, k in names.items()]))
        found = df.select(F.explode(cells).alias("e")).select("e.*").where("spelling IS NOT NULL").groupBy("c", "spelling").agg(F.count(F.lit(1)).alias("n"))
        return Step("", merged=(names, written(best_of(found).where("spelling <> best").select("c", "spelling", "best"))))

    def _case_variants(self, df):
        return self._merged(df, lambda d: quality.grouped_spellings(d, F.lower))

    def _accent_variants(self, df):
        return self._merged(df, quality.by_accents)

    def _near_labels(self, df):
        """The rarer of two labels that look like a typing error takes the more frequent one."""
        return self._merged(df, lambda d: quality.label_pairs(d, 200).groupBy("c", F.col("variant").alias("spelling")).agg(F.min_by("probable", F.struct("distance", "probable")).alias("best")), trimmed)

    def _to_numeric(self, df):
        known = {p.name: p for p in self.columns if p.type == "numeric" and p.role == "measure"}
        texts = self._texts(df)
        return Step("", sets={c: p.number() for c, p in known.items() if c in texts} or ({self.amount: numeric_text(F.col(f"`{self.amount}`"), False)} if self.amount in texts else {}))

    def _parse_dates(self, df):
        known = {p.name: p for p in self.columns if p.type == "datetime"}
        texts = self._texts(df)
        return Step("", sets={c: p.moment() for c, p in known.items() if c in texts} or ({self.date: parsed_date(F.col(f"`{self.date}`"), DATE_FORMATS)} if self.date in texts else {}))

    def _extreme_outliers(self, df):
        return Step("", gone=written(quality.extreme_outliers(df, self.row_id, self.amount).select(F.col(f"`{self.row_id}`"))))

    def _negative(self, df):
        return Step("", drop=F.col(f"`{self.amount}`") < 0, aside="refunds" if self.decisions["M01_negative"] == "separate" else None)

    def _zero_values(self, df):
        return Step("", drop=F.col(f"`{self.amount}`") == 0)

    def _absurd_dates(self, df):
        return Step("", sets={self.date: F.when(F.year(f"`{self.date}`") >= 1990, F.col(f"`{self.date}`"))})

    def _future_dates(self, df):
        return Step("", drop=F.col(f"`{self.date}`") > F.lit(self.as_of).cast("timestamp_ntz"))

    def _critical_missing(self, df):
        return Step("", drop=reduce(or_, [F.col(f"`{c}`").isNull() for c in (self.amount, self.date, self.order) if c]))
