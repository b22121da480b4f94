"""Profiles of columns over all rows: their distinct values from one pass, sums over these, then decisions on the driver."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.text import DATE_FORMATS, comma_decision, comma_tests, day_first_tests, day_order, is_null_token, numeric_text, parsed_date, ranked_formats, read_date, trimmed
from tallymark.operators.stats import exact_median, exact_medians
from tallymark.sources.scan import written

# Words of yes and no; words in names of identifiers, dates, measures, and measures that aren't added up.
BOOLEAN_WORDS = ("oui", "non", "yes", "no", "true", "false", "vrai", "faux", "1", "0", "y", "n", "o")
ID_HINTS = ("id", "ident", "code", "ref", "reference", "sku", "uuid", "num", "numero", "no", "identifiant", "key")
DATE_HINTS = ("date", "jour", "day", "time", "timestamp", "created", "purchase", "commande", "achat", "livraison", "shipping", "delivery", "at")
MEASURE_HINTS = (
    "prix", "price", "montant", "amount", "total", "ca", "revenue", "chiffre", "cout", "cost", "valeur", "value", "quantite", "quantity", "qty", "qte", "nombre", "freight",
    "payment", "subtotal", "tarif", "somme",
)
NON_ADDITIVE_HINTS = (
    "taux", "rate", "ratio", "pct", "pourcentage", "percent", "moyenne", "mean", "avg", "note", "rating", "score", "age", "poids_unitaire", "unit_price", "prix_unitaire",
    "latitude", "longitude", "lat", "lng", "lon", "zip", "postal", "cp",
)
#: A text column has a type if this share of its values reads as it.
TYPE_SHARE = 0.9


@dataclass(frozen=True)
class ColumnProfile:
    """What all rows of a column show. Shares are of its values, which leave null words out."""

    name: str
    type: str
    role: str
    n: int
    n_present: int
    n_unique: int
    native: bool = True
    additive: bool | None = None
    min: float | None = None
    max: float | None = None
    median: float | None = None
    n_negative: int = 0
    n_zero: int = 0
    first: object = None
    last: object = None
    n_read: int = 0
    date_format: str | None = None
    day_order: str = "undecided"
    n_day_month: int = 0
    decimal_comma: bool = True
    comma_confidence: float = 1.0
    comma_share: float = 0.0
    currency_share: float = 0.0
    email_share: float = 0.0
    whole_share: float = 0.0
    top: tuple[str, ...] = ()

    @property
    def null_rate(self) -> float:
        return 1 - self.n_present / self.n if self.n else 0.0

    @property
    def ratio(self) -> float:
        return self.n_unique / self.n_present if self.n_present else 0.0

    def number(self) -> Column:
        """The column as numbers, null where a value is none."""
        return F.col(f"`{self.name}`").cast("double") if self.native else self.read_number(F.col(f"`{self.name}`"))

    def moment(self) -> Column:
        """The column as timestamps, null where a value is none."""
        return F.col(f"`{self.name}`").cast("timestamp_ntz") if self.native else self.read_moment(F.col(f"`{self.name}`"))

    def read_number(self, text: Column) -> Column:
        """The number that a text is in this column."""
        return numeric_text(text, self.decimal_comma)

    def read_moment(self, text: Column) -> Column:
        return parsed_date(text, (self.date_format, *ranked_formats(self.day_order)) if self.date_format else tuple(ranked_formats(self.day_order)))


def numeric(df: DataFrame, c: str) -> DataFrame:
    """Range, moments with the sample skewness, and counts of negative and zero values."""
    n = F.count(c)
    skew = F.skewness(c) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))
    return df.agg(
        n.alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.when(n > 2, skew).alias("skew"), F.count_if(F.col(c) < 0).alias("n_negative"), F.count_if(F.col(c) == 0).alias("n_zero"),
    ).withColumn("median", exact_median(df, c).scalar())


def temporal(df: DataFrame, c: str, as_of: Column) -> DataFrame:
    return df.agg(F.date_format(F.min(c), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(c), "yyyy-MM-dd").alias("last_day"), F.datediff(F.max(c), F.min(c)).cast("long").alias("span_days"), F.count_if(F.col(c) > as_of).alias("n_future"))


def cardinality(df: DataFrame, c: str) -> DataFrame:
    """Rows, missing ones (null words count), distinct values, and distinct over present."""
    text = F.col(c).cast("string")
    v = F.when(~is_null_token(text), text)
    return df.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("n_null"), F.count_distinct(v).alias("n_unique"), F.try_divide(F.count_distinct(v), F.count(v)).alias("ratio"))


def top_values(df: DataFrame, c: str, k: int = 10) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def normal(name: str) -> str:
    """Lower case without accents, words apart by single spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[\W_]+", " ", plain.lower()).split())


def hinted(name: str, hints: tuple[str, ...]) -> bool:
    """Whether a name has one of the words, or contains one of over three letters."""
    n = normal(name)
    return bool(set(n.split()) & set(hints)) or any(h.replace("_", " ") in n for h in hints if len(h) > 3)


#: The first that holds gives the role. x: name, kind, n (present), n_unique, ratio, decimals.
_ROLES = (
    ("empty", lambda x: not x["n"]),
    ("constant", lambda x: x["n_unique"] == 1),
    ("measure", lambda x: x["kind"] == "numeric" and hinted(x["name"], MEASURE_HINTS) and not hinted(x["name"], ID_HINTS)),
    ("temporal", lambda x: x["kind"] == "datetime"),
    ("identifier", lambda x: x["n_unique"] > 10 and hinted(x["name"], ID_HINTS) and not hinted(x["name"], NON_ADDITIVE_HINTS)),
    ("identifier", lambda x: x["ratio"] > 0.9 and x["n"] > 20 and not x["decimals"]),
    ("boolean_flag", lambda x: x["kind"] == "boolean" or x["n_unique"] == 2),
    ("measure", lambda x: x["kind"] == "numeric" and (x["ratio"] > 0.05 or x["decimals"])),
    ("categorical", lambda x: x["kind"] == "numeric" or x["n_unique"] <= 200),
    ("high_cardinality_cat", lambda x: True),
)


def role(name: str, kind: str, n_rows: int, n_present: int, n_unique: int, decimals: bool) -> str:
    """The structural role, by the first rule that holds."""
    x = {"name": name, "kind": kind, "n": n_present, "n_unique": n_unique, "ratio": n_unique / n_present if n_present else 0.0, "decimals": decimals}
    return next(r for r, holds in _ROLES if holds(x))


def _native(t: T.DataType) -> str | None:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "boolean" if isinstance(t, T.BooleanType) else None


def _tests_of_text(v: Column) -> dict[str, Column]:
    """What tells a text column's type, as conditions on a value."""
    out = {"n_boolean": F.lower(trimmed(v)).isin(*BOOLEAN_WORDS), "n_comma": F.contains(v, F.lit(",")), "n_currency": v.rlike(r"[€$£¥]|R\$")}
    out |= {"n_email": v.rlike(r"^\s*[^@\s]+@[^@\s]+\.[A-Za-z]{2,}\s*$"), "n_digits": v.rlike(r"^\d{5,}$")}
    out |= comma_tests(v) | day_first_tests(v)
    out |= {"n_with_comma": numeric_text(v, True).isNotNull(), "n_with_point": numeric_text(v, False).isNotNull()}
    return out | {f"date{k}": read_date(v, f).isNotNull() for k, f in enumerate(DATE_FORMATS)} | {"n_mixed": parsed_date(v, DATE_FORMATS).isNotNull()}


def _text_type(name: str, n: int, s) -> tuple[str, dict]:
    """The type of a text column by its sums, and what was decided on the way."""
    comma, sure = comma_decision(s["n_tail"], s["n_zero_first"], s["n_groups"], s["n_comma_point"])
    order, _ = day_order(n, s["n_dates"], s["n_day_first"], s["n_month_first"])
    ranked = ranked_formats(order)
    counts = {f: s[f"date{DATE_FORMATS.index(f)}"] for f in ranked}
    best = next((f for f in ranked if counts[f] >= 0.99 * n), max(ranked, key=counts.get))
    n_date = counts[best]
    if n_date < TYPE_SHARE * n:  # mixed forms, each read by the first that fits
        best, n_date = None, max(n_date, s["n_mixed"])
    n_number = s["n_with_comma" if comma == "decimal" else "n_with_point"]
    found = {"decimal_comma": comma == "decimal", "comma_confidence": sure, "comma_share": s["n_comma"] / n if n else 0.0, "currency_share": s["n_currency"] / n if n else 0.0, "email_share": s["n_email"] / n if n else 0.0, "day_order": order, "n_day_month": s["n_dates"], "date_format": best}
    if not n:
        return "text", found
    dated = n_date >= TYPE_SHARE * n and s["n_digits"] <= 0.5 * n and n_date >= n_number and (hinted(name, DATE_HINTS) or n_date > 0.95 * n)
    kind = "datetime" if dated else "numeric" if n_number >= TYPE_SHARE * n else "boolean" if s["n_boolean"] == n else "text"
    return kind, found | {"n_read": n_date if dated else n_number}


#: Longer values are counted by their hashes alone, and are neither numbers nor dates; they are read again only if a category has them.
LONG_VALUE = 1024


def value_counts(df: DataFrame, cells: list[Column]) -> DataFrame:
    """(c, v, long, n): the distinct values of many columns, as text, with their rows, from one scan and one shuffle.

    A row becomes one small row a column; equal ones are added up in their task
    before they are sent. Both ``v`` and ``long`` are null for missing values. A
    value of over ``LONG_VALUE`` letters is told apart by 128 bits of hash.
    """
    d = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("c"), v.alias("v")) for k, v in enumerate(cells)])).alias("e")).select("e.*")
    is_long = F.length("v") > LONG_VALUE
    hashes = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    return d.select("c", F.when(is_long, None).otherwise(F.col("v")).alias("v"), F.when(is_long, hashes).alias("long")).groupBy("c", "v", "long").agg(F.count(F.lit(1)).alias("n"))


def table(df: DataFrame) -> list[ColumnProfile]:
    """The profiles of all columns; nothing is sampled.

    The table is read once: the distinct values of all columns are counted and
    written to the shared folder, and all else comes from these. Only profiles
    come to the driver.
    """
    return profiled(df)[0]


def _as_text(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0).cast(f.dataType)).cast("string")  # -0.0 is 0.0
    return F.unix_micros(c).cast("string") if isinstance(f.dataType, T.TimestampType) else c.cast("string")


def _from_text(v: Column, t: T.DataType) -> Column:
    """A moment by the text of a native column."""
    return F.timestamp_micros(v.cast("long")).cast("timestamp_ntz") if isinstance(t, T.TimestampType) else v.cast("timestamp_ntz")


def profiled(df: DataFrame) -> tuple[list[ColumnProfile], DataFrame | None]:
    """``table``, and the distinct present values (c, v, long, x, m, n) behind it, as text, number and moment; ``c`` is the place of the column's profile. None without columns."""
    fields = [f for f in df.schema if _native(f.dataType) or isinstance(f.dataType, T.StringType)]
    if not fields:
        return [], None
    kinds = [_native(f.dataType) for f in fields]
    texts = [k for k, kind in enumerate(kinds) if kind is None]
    v, n, c = F.col("v"), F.col("n"), F.col("c")
    rows = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0))
    counted = written(value_counts(df, [_as_text(f) for f in fields]))
    there = F.col("long").isNotNull() | F.when(c.isin(texts), ~is_null_token(v)).otherwise(v.isNotNull())
    own = {r.c: r for r in counted.groupBy("c").agg(F.sum("n").alias("n_rows"), rows(there).alias("n"), F.count_if(there).alias("n_unique"), F.max(F.col("long").isNotNull()).alias("has_long")).collect()}
    n_rows = own[0].n_rows if own else 0
    present = counted.where(there)
    tests = {r.c: r for r in present.where(c.isin(texts)).groupBy("c").agg(*[rows(x).alias(k) for k, x in _tests_of_text(v).items()]).collect()} if texts else {}
    none = dict.fromkeys(_tests_of_text(v), 0)
    draft: list[ColumnProfile] = []
    for k, (f, kind) in enumerate(zip(fields, kinds, strict=True)):
        n_present = own[k].n if k in own else 0
        kind, found = (kind, {}) if kind else _text_type(f.name, n_present, tests.get(k, none))
        draft.append(ColumnProfile(f.name, kind, "", n_rows, n_present, own[k].n_unique if k in own else 0, kinds[k] is not None, **found))

    def read(kind: str, of) -> Column:
        """What the values of all columns of a kind read as."""
        known = [F.when(c == k, of(k, p)) for k, p in enumerate(draft) if p.type == kind]
        return F.coalesce(*known) if known else F.lit(None)

    number = lambda k, p: (v.cast("float") if isinstance(fields[k].dataType, T.FloatType) else v).cast("double") if p.native else p.read_number(v)
    moment = lambda k, p: _from_text(v, fields[k].dataType) if p.native else p.read_moment(v)
    values = present.select("c", "v", "long", read("numeric", number).cast("double").alias("x"), read("datetime", moment).cast("timestamp_ntz").alias("m"), "n")
    x = F.col("x")
    sums = values.where(c.isin([k for k, p in enumerate(draft) if p.type in ("numeric", "datetime")])).groupBy("c").agg(
        rows(x.isNotNull()).alias("n_read"), F.min(x).alias("min"), F.max(x).alias("max"), rows(x < 0).alias("n_negative"), rows(x == 0).alias("n_zero"), rows(x % 1 == 0).alias("n_whole"),
        rows(x.between(0, 1)).alias("n_unit"), F.min("m").alias("first"), F.max("m").alias("last"),
    )
    of = {r.c: r.asDict() for r in sums.collect()}
    nothing = {k: None if k in ("min", "max", "first", "last") else 0 for k in sums.columns}
    numbers = [k for k, p in enumerate(draft) if p.type == "numeric" and p.n_present]
    median = {m.c: m.m for m in exact_medians(values.where(c.isin(numbers)), ["c"], "x", weight="n").collect()} if numbers else {}
    out = []
    for k, p in enumerate(draft):
        s, total, is_number = of.get(k, nothing), max(1, p.n_present), p.type == "numeric"
        if isinstance(fields[k].dataType, T.DateType):
            s = s | {e: s[e] and s[e].date() for e in ("first", "last")}
        r = role(p.name, p.type, p.n, p.n_present, p.n_unique, is_number and s["n_read"] - s["n_whole"] > 0.05 * total)
        more = {e: s[e] for e in ("min", "max", "first", "last") if s[e] is not None}
        more |= {"n_negative": s["n_negative"], "n_zero": s["n_zero"]} if is_number else {}
        more |= {"n_read": s["n_read"] if p.native and is_number else p.n_read or p.n_present, "median": median.get(k), "whole_share": s["n_whole"] / total if is_number else 0.0}
        more["additive"] = not hinted(p.name, NON_ADDITIVE_HINTS) and s["n_unit"] <= 0.95 * total if r == "measure" else None
        out.append(ColumnProfile(**(vars(p) | {"role": r} | more)))
    named = [k for k, p in enumerate(out) if p.role in ("categorical", "boolean_flag")]
    if not named:
        return out, values
    place = F.row_number().over(W.partitionBy("c").orderBy(F.desc("n"), "v"))
    tops = present.where(c.isin(named) & v.isNotNull()).withColumn("place", place).where("place <= 10").select("c", "v", "n").collect()
    by_column = {k: tuple(r.v for r in sorted((r for r in tops if r.c == k), key=lambda r: (-r.n, r.v))) for k in named}
    for k in named:
        if own[k].has_long:  # a category of long texts: they are read
            by_column[k] = tuple(r.value for r in top_values(df.select(F.col(f"`{fields[k].name}`").alias("v")), "v").collect())
    return [ColumnProfile(**(vars(p) | {"top": by_column.get(k, ())})) for k, p in enumerate(out)], values


def roles(df: DataFrame) -> dict[str, str]:
    """Roles of all columns."""
    return {p.name: p.role for p in table(df)}


def text_types(df: DataFrame, names: list[str], share: float = TYPE_SHARE) -> DataFrame:
    """column, n (present values), and the type that ``share`` of them read as, from one pass over all rows."""
    sums = []
    for c in names:
        v = F.when(~is_null_token(F.col(c)), trimmed(F.col(c)))
        dates = [F.count(read_date(v, f)) for f in DATE_FORMATS]
        sums.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("n"), F.count_if(F.lower(v).isin(*BOOLEAN_WORDS)).alias("n_boolean"),
            F.count(F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v.try_cast("double"))).alias("n_numeric"), F.greatest(*dates).alias("n_date"),
        ))
    d = df.agg(F.array(*sums).alias("x")).select(F.inline("x"))
    least = F.col("n") * share
    kind = F.when(F.col("n") == 0, "text").when(F.col("n_boolean") == F.col("n"), "boolean").when(F.col("n_numeric") >= least, "numeric").when(F.col("n_date") >= least, "datetime").otherwise("text")
    return d.select("column", "n", kind.alias("type"))


def simple_role(n: int, n_unique: int) -> str:
    """The role that the number of distinct values alone gives."""
    return "identifier" if n and n_unique / n > 0.9 else "categorical" if n_unique <= 200 else "high_cardinality"


def distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n_unique, n): distinct values that aren't null, and rows, of columns of any type, from one scan and one shuffle."""
    place = {k: f for k, f in enumerate(df.select(*[f"`{c}`" for c in names]).schema)}
    d = value_counts(df, [_as_text(f) for f in place.values()])
    d = d.groupBy("c").agg(F.count_if(F.col("v").isNotNull() | F.col("long").isNotNull()).alias("n_unique"), F.sum("n").alias("n"))
    return d.select(F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1).alias("column"), "n_unique", "n")


def simple_roles(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n_unique, role) by the number of distinct values alone."""
    u = F.col("n_unique")
    role_ = F.when(F.try_divide(u, F.col("n")) > 0.9, "identifier").when(u <= 200, "categorical").otherwise("high_cardinality")
    return distinct_counts(df, names).select("column", "n_unique", role_.alias("role"))


def sampling_error(df: DataFrame, names: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """column, distinct share and null share over all rows and over a sample of them, and their distances: what sampling would do to roles."""
    def shares(d: DataFrame, what: str) -> DataFrame:
        one = d.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c).alias(c) for c in names], *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in names])
        return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.try_divide(F.col(c), F.col("rows")).alias(what), F.try_divide(F.col(f"null_{c}"), F.col("rows")).alias(f"{what}_null")) for c in names])))

    d = shares(df, "exact").join(shares(df.sample(fraction, seed), "sampled"), "column")
    return d.select("column", "exact", "sampled", F.abs(F.col("exact") - F.col("sampled")).alias("error"), F.abs(F.col("exact_null") - F.col("sampled_null")).alias("null_error"))


def strategies(df: DataFrame, names: list[str], order: str, head: int = 20_000) -> DataFrame:
    """(strategy, n_right, accuracy, wrong): roles by cardinality from all rows, from the first ``head`` by ``order``, and from exact counts next to such a head.

    The head is the feature that is judged here; nothing else reads it.
    """
    def roles_of(d: DataFrame) -> dict[str, str]:
        found = {r.column: r.role for r in simple_roles(d, names).collect()}
        return {c: found.get(c, simple_role(0, 0)) for c in names}

    true, part = roles_of(df), roles_of(df.orderBy(order).limit(head))
    rows = []
    for strategy, found in (("full", true), ("head", part), ("hybrid", true)):
        wrong = [c for c in names if found[c] != true[c]]
        rows.append((strategy, len(names) - len(wrong), (len(names) - len(wrong)) / len(names), ",".join(wrong)))
    return df.sparkSession.createDataFrame(rows, "strategy string, n_right int, accuracy double, wrong string")


def benchmark(spark, volumes: list[int], seed: int = 0) -> DataFrame:
    """(operation, n_rows, seconds, n_out, peak_mb) of reading, profiling and aggregating a generated sales file of each volume.

    Each operation runs once, after the garbage of the one before is gone. The
    peak is the largest that any of the session's machines has used of its heap
    so far, from Spark's own figures, and null where its interface is off.
    """
    import gc
    import time

    from tallymark.operators.execute import grouped
    from tallymark.plans.spec import Dimension, Spec
    from tallymark.sources.scan import sample_sales, scan, scratch_folder, write_csv

    spec = Spec("montant", "sum", (Dimension("date", "temporal", "month"), Dimension("categorie")))
    rows = []
    for n in volumes:
        path = f"{scratch_folder(spark)}/sales"
        write_csv(sample_sales(spark, n, seed), path)
        text = scan(spark, path)[0]
        typed = text.withColumns({"date": F.col("date").try_cast("date"), "montant": F.col("montant").try_cast("double")})
        for name, run in (
            ("read", lambda: scan(spark, path)[0].count()),  # noqa: B023
            ("profile", lambda: distinct_counts(text, text.columns).count()),  # noqa: B023
            ("aggregate", lambda: grouped(typed, spec).count()),  # noqa: B023
        ):
            gc.collect()
            start = time.perf_counter()
            out = run()
            rows.append((name, n, time.perf_counter() - start, out, _peak_mb(spark)))
    return spark.createDataFrame(rows, "operation string, n_rows long, seconds double, n_out long, peak_mb double")


def _peak_mb(spark) -> float | None:
    """The largest heap of a machine of the session, by its monitoring interface."""
    import json
    from urllib.request import urlopen

    base = spark.sparkContext.uiWebUrl
    if not base:
        return None
    with urlopen(f"{base}/api/v1/applications/{spark.sparkContext.applicationId}/executors", timeout=10) as r:
        used = [x.get("peakMemoryMetrics", {}).get("JVMHeapMemory", 0) for x in json.load(r)]
    return max(used, default=0) / (1 << 20) or None
