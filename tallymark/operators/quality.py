"""Quality detectors: each is one aggregate or window over the table, and never changes it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.functions.text import has_test_word, is_cancelled, is_cancelled_exactly, is_null_token, is_total, strip_accents, trimmed
from tallymark.operators import profile
from tallymark.operators.profile import ColumnProfile
from tallymark.operators.stats import exact_median, exact_medians, with_robust_z

# Severity, policy and default of issues; what they take from the score; which of them touch which share of it.
RULES = {
    "S01_encoding": ("low", "AUTO", None), "S02_separator": ("low", "AUTO", None), "S04_header_offset": ("low", "AUTO", None), "S05_empty_columns": ("low", "AUTO", "drop"),
    "S06_constant_columns": ("low", "AUTO_NOTIFIED", "drop"), "S07_total_rows": ("high", "AUTO_NOTIFIED", "remove"), "S09_duplicate_headers": ("low", "AUTO", None),
    "D01_exact_duplicates": ("high", "ASK", "remove_duplicates"), "D02_id_duplicates": ("medium", "ASK", "remove_duplicates"), "D02_multiline_orders": ("low", "AUTO", None), "D03_near_duplicates": ("medium", "ASK", "review"),
    "T01_unparsable": ("high", "ASK", "exclude"), "T02_ambiguous_format": ("high", "ASK", "dayfirst"), "T03_future_dates": ("medium", "ASK", "keep"), "T04_absurd_dates": ("medium", "AUTO_NOTIFIED", "null"),
    "T06_insufficient_span": ("medium", "AUTO_NOTIFIED", None),
    "M01_negative": ("medium", "ASK", "separate"), "M02_zero_values": ("low", "ASK", "exclude"), "M03_extreme_outliers": ("high", "ASK", "preview"), "M04_currency_symbols": ("low", "AUTO", "to_numeric"),
    "M07_ambiguous_decimal": ("high", "ASK", "decimal"),
    "C01_whitespace": ("low", "AUTO", "trim"), "C02_case_variants": ("medium", "AUTO_NOTIFIED", "merge"), "C03_accent_variants": ("medium", "ASK", "merge"), "C04_near_duplicates": ("medium", "ASK", "merge"),
    "C05_null_placeholders": ("low", "AUTO", "null"), "C06_high_cardinality": ("low", "AUTO_NOTIFIED", None),
    "N01_critical_missing": ("high", "ASK", "exclude"), "N02_high_null_rate": ("medium", "AUTO_NOTIFIED", None), "N03_moderate_missing": ("low", "AUTO_NOTIFIED", None),
    "X01_test_rows": ("medium", "ASK", "exclude"), "X02_cancelled_orders": ("high", "ASK", "separate"), "X03_internal_orders": ("low", "ASK", "keep"),
    "B01_no_rows": ("high", "BLOCK", None), "B02_no_measure": ("high", "BLOCK", None), "B03_no_date": ("medium", "AUTO_NOTIFIED", None),
    "R01_amount_mismatch": ("high", "ASK", "preview"), "R02_delivery_before_order": ("high", "ASK", "preview"), "R03_delivery_delay": ("medium", "AUTO_NOTIFIED", None), "R04_total_mismatch": ("high", "ASK", "preview"),
    "R05_implied_price_outlier": ("medium", "ASK", "preview"), "R06_cancelled_with_amount": ("high", "ASK", "zero_out"), "R07_shipping_exceeds_amount": ("medium", "AUTO_NOTIFIED", None),
}
PENALTY = {("BLOCK", "high"): 40, ("ASK", "high"): 9, ("ASK", "medium"): 5, ("ASK", "low"): 2, ("AUTO_NOTIFIED", "high"): 4}
SHARES = {
    "consistency": ("C01_whitespace", "C02_case_variants", "C03_accent_variants", "C04_near_duplicates", "S07_total_rows"),
    "validity": ("T01_unparsable", "T03_future_dates", "T04_absurd_dates", "M01_negative", "M03_extreme_outliers", "X01_test_rows", "M07_ambiguous_decimal", "X02_cancelled_orders"),
    "uniqueness": ("D01_exact_duplicates", "D02_id_duplicates", "D03_near_duplicates"),
}
SEVERITIES = ("high", "medium", "low")


@dataclass(frozen=True)
class Issue:
    id: str
    severity: str
    policy: str
    columns: tuple[str, ...]
    n_affected: int
    default: str | None = None
    #: What was found in particular, by name; row ids of the first rows that show it.
    details: dict = field(default_factory=dict, compare=False)
    samples: tuple = ()

    @property
    def options(self) -> tuple[str, ...]:
        """What a user may decide, the default first; none where nothing is asked."""
        from tallymark.operators.clean import CHOICES, FIRST_KEEP

        if self.id not in CHOICES:
            return ()
        every = (*CHOICES[self.id], FIRST_KEEP.get(self.id, "keep"))
        return tuple(sorted(every, key=lambda x: x != self.default))


def counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """Rows, and rows that meet each condition, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def any_column(df: DataFrame, test) -> Column:
    """Whether any text column meets a test."""
    out = F.lit(False)
    for f in df.schema:
        if f.dataType.simpleString() == "string":
            out = out | test(F.col(f.name))
    return out


def total_rows(df: DataFrame) -> Column:
    return any_column(df, is_total)


def test_rows(df: DataFrame) -> Column:
    return any_column(df, has_test_word)


def row_hash(columns: list[str]) -> Column:
    """128 bits of a row's values; nulls are equal to nulls and to nothing else."""
    cells = [F.col(f"`{c}`") for c in columns]
    cells += [c.isNull() for c in cells]
    return F.struct(F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells))


def firsts(df: DataFrame, keys: Column | list[str], row_id: str) -> DataFrame:
    """(row_id) of the first row of each group of equal keys; nulls are equal. Groups are added up in their tasks, so none is too large."""
    by = [F.col(f"`{k}`").alias(f"__k{n}") for n, k in enumerate(keys)] if isinstance(keys, list) else [keys.alias("__k0")]
    d = df.select(*by, F.col(f"`{row_id}`").alias("__id"))
    return d.groupBy(*[f"__k{n}" for n in range(len(by))]).agg(F.min("__id").alias(row_id)).select(F.col(f"`{row_id}`"))


def one_of_each(df: DataFrame, keys: Column | list[str], row_id: str) -> DataFrame:
    """The first row of each group of equal keys. ``row_id`` numbers the rows: it is never null or repeated, so this join has no hot key."""
    return df.join(firsts(df, keys, row_id), row_id, "left_semi").select(*[f"`{c}`" for c in df.columns])


def exact_duplicates(df: DataFrame, row_id: str) -> DataFrame:
    """Rows equal in all columns but ``row_id`` to a row before them; nulls are equal."""
    rest = [c for c in df.columns if c != row_id]
    return df.join(firsts(df, row_hash(rest), row_id), row_id, "left_anti").select(*[f"`{c}`" for c in df.columns])


def near_duplicates(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Rows equal in ``keys`` to a row before them, but not in all columns; of copies of a row the first one counts."""
    rest = [c for c in df.columns if c != row_id]
    by = [f"__k{n}" for n in range(len(keys))]
    d = df.select(*[F.col(f"`{k}`").alias(b) for k, b in zip(keys, by, strict=True)], row_hash(rest).alias("__h"), F.col(f"`{row_id}`").alias("__id"))
    each = d.groupBy(*by, "__h").agg(F.min("__id").alias("__id"))
    found = each.select("__id").join(each.groupBy(*by).agg(F.min("__id").alias("__id")).select("__id"), "__id", "left_anti")
    return df.join(found.withColumnRenamed("__id", row_id), row_id, "left_semi").select(*[f"`{c}`" for c in df.columns])


def multiline(df: DataFrame, order: str) -> DataFrame:
    """Orders with several rows, and their number of rows."""
    return df.groupBy(order).agg(F.count(F.lit(1)).alias("n_lines")).where("n_lines > 1")


def spellings(df: DataFrame, c: str) -> DataFrame:
    """(c, spelling, n) of a column's values; ``c`` is 0."""
    return df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("spelling")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("c"), "spelling", "n")


def grouped_spellings(d: DataFrame, key) -> DataFrame:
    """(c, spelling, n, k, best) of spellings that share ``key(spelling)`` with another one of their column, and the most frequent of each group."""
    d = d.withColumn("k", key(F.col("spelling")))
    group = W.partitionBy("c", "k")
    d = d.withColumn("m", F.count(F.lit(1)).over(group)).withColumn("best", F.first("spelling").over(group.orderBy(F.desc("n"), "spelling")))
    return d.where("m > 1").drop("m")


def _accentless(c: Column) -> Column:
    return strip_accents(F.lower(c))


def by_accents(d: DataFrame) -> DataFrame:
    """Groups without accents and case that case alone doesn't explain."""
    d = grouped_spellings(d, _accentless)
    return d.withColumn("forms", F.collect_set(F.lower("spelling")).over(W.partitionBy("c", "k"))).where(F.size("forms") > 1).drop("forms")


def variants(df: DataFrame, c: str, key) -> DataFrame:
    """Spellings that share ``key(spelling)`` with another one, and the most frequent of each group."""
    return grouped_spellings(spellings(df, c), key).select("spelling", "n", "best")


def case_variants(df: DataFrame, c: str) -> DataFrame:
    return variants(df, c, F.lower)


def accent_variants(df: DataFrame, c: str) -> DataFrame:
    """Spellings that are equal without accents and case, in groups that case alone doesn't explain."""
    return by_accents(spellings(df, c)).select("spelling", "n", "best")


def _one_word_off(a: Column, b: Column) -> Column:
    """Whether labels of several words have as many words, and none that differs by more than an edit."""
    x, y = (F.split(strip_accents(F.lower(c)), r"\s+") for c in (a, b))
    alike = F.forall(F.zip_with(x, y, lambda v, w: (v == w) | (F.levenshtein(v, w) <= 1)), lambda ok: ok)
    return (F.size(x) == 1) & (F.size(y) == 1) | (F.size(x) == F.size(y)) & alike


def near_labels(df: DataFrame, c: str, most: int = 200) -> DataFrame:
    """(a, b, distance, probable, variant, n) of pairs of labels that look like a typing error; ``n`` rows have the rarer one.

    Labels are one edit apart, or two from eight letters on, but for their
    case, and differ within words, not by whole ones. A column with more than
    ``most`` labels, with mostly numbers, or of short values (under six
    letters for half of them) gives no pairs: its values aren't categories.
    """
    v = df.select(trimmed(F.col(f"`{c}`").cast("string")).alias("spelling")).where("spelling IS NOT NULL").groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))
    return label_pairs(v.select(F.lit(0).alias("c"), "spelling", "n"), most).drop("c")


#: Labels of more letters than this are compared by the parts that an edit leaves whole, as they have too many deletions.
LONG_LABEL = 40


def _deletions(s: Column) -> Column:
    """A text and what is left of it without any one of its letters."""
    each = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.array_union(F.array(s), F.when(F.length(s) > 0, each).otherwise(F.array()))


def _neighbour_keys(s: Column) -> Column:
    """Texts that two labels share if they are two edits apart or less.

    Short labels: what is left without up to two letters, one under eight. Long ones: a third of
    the label and where it begins, give or take two; two edits leave one of
    three thirds whole.
    """
    n = F.length(s)
    few = F.when(n < 8, _deletions(s)).otherwise(F.flatten(F.transform(_deletions(s), _deletions)))
    third = F.floor(n / 3).cast("int")
    # A third is looked for at all lengths that the other label's thirds may have.
    cut = lambda k, size, off: F.concat_ws(":", F.lit("#"), size.cast("string"), F.lit(k).cast("string"), F.substring(s, (F.lit(k) * third + off + 1).cast("int"), size))
    parts = [cut(k, third + d, F.lit(off)) for k in range(3) for d in (-1, 0, 1) for off in range(-4, 5)]
    return F.array_distinct(F.when(n <= LONG_LABEL - 2, few).when(n > LONG_LABEL + 2, F.array(*parts)).otherwise(F.concat(few, F.array(*parts))))


def label_pairs(labels: DataFrame, most: int) -> DataFrame:
    """``near_labels`` for many columns at once: (c, spelling, n) are their labels. Labels meet by what they share, not pair by pair."""
    bare = F.regexp_replace("spelling", r"[\s.,%-]", "")
    sums = labels.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"), F.sum(F.when(bare.rlike(r"^\d+$"), F.col("n")).otherwise(0)).alias("numbers"), F.sum(F.when(F.length("spelling") < 6, F.col("n")).otherwise(0)).alias("short"))
    fit = sums.where(F.col("k").between(2, most) & (2 * F.col("numbers") <= F.col("rows")) & (2 * F.col("short") <= F.col("rows"))).select("c")  # a row a column
    d = labels.join(fit, "c", "left_semi").withColumn("low", F.lower("spelling"))
    keyed = d.select("c", "spelling", "n", "low", F.explode(_neighbour_keys(F.col("low"))).alias("key"))
    x, y = (keyed.select("c", "key", *[F.col(k).alias(f"{k}_{t}") for k in ("spelling", "n", "low")]) for t in "ab")
    pairs = x.join(y, ["c", "key"]).where("spelling_a < spelling_b").drop("key").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("low_a", "low_b", 2)).withColumnsRenamed({"spelling_a": "a", "spelling_b": "b"})
    pairs = pairs.where(((F.col("distance") == 1) | (F.col("distance") == 2) & (F.least(F.length("a"), F.length("b")) >= 8)) & _one_word_off(F.col("a"), F.col("b")))
    first = F.col("n_a") >= F.col("n_b")
    return pairs.select("c", "a", "b", "distance", F.when(first, F.col("a")).otherwise(F.col("b")).alias("probable"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("variant"), F.least("n_a", "n_b").alias("n"))


def extreme_outliers(df: DataFrame, row_id: str, c: str) -> DataFrame:
    d = with_robust_z(df.where(F.col(c).isNotNull()).select(row_id, F.col(c).alias("value")))
    return d.where((F.col("z") > 10) & (F.abs("value") > 20 * F.col("med"))).select(row_id, "value")


def amount_mismatch(df: DataFrame, revenue: str, quantity: str, price: str, discount: str) -> DataFrame:
    """Rows off by over 2 % from quantity * price, with and without the discount; the formula with more rows in order counts."""
    off = lambda x: _off(F.col(revenue), x)
    plain = F.col(quantity) * F.col(price)
    d = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(off(plain)).alias("n_plain"), F.count_if(off(plain * (1 - F.col(discount)))).alias("n_discounted"))
    return d.withColumn("n_off", F.least("n_plain", "n_discounted"))


def _off(amount: Column, expected: Column) -> Column:
    return F.abs(amount - expected) / F.nullif(F.abs(expected), F.lit(0.0)) > 0.02


def order_totals(df: DataFrame, order: str, total: str, line: str) -> DataFrame:
    """Orders whose total, the smallest that their rows give, is over 2 % off the sum of their lines."""
    d = df.groupBy(order).agg(F.min(total).alias("total"), F.sum(line).alias("lines"), F.count(F.lit(1)).alias("n"))
    return d.where(F.abs(F.col("total") - F.col("lines")) / F.nullif(F.abs("lines"), F.lit(0.0)) > 0.02).select(order, "n")


def without_empty(df: DataFrame, constant: bool = True) -> DataFrame:
    """Without columns that hold no value, or (``constant``) a single one in all rows; an empty table keeps all."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count(f"`{c}`").alias("k"), F.min(f"`{c}`").eqNullSafe(F.max(f"`{c}`")).alias("one")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    n = r[0]
    return df.drop(*[c for c, x in zip(df.columns, r[1:], strict=True) if n and (not x["k"] or (constant and x["one"] and x["k"] == n))])


def status_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns with values that are words for a cancelled order, and how many such values."""
    is_word = [F.when(is_cancelled_exactly(F.col(c)), F.col(c)) for c in names]
    one = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(w).alias("n_status_values")) for c, w in zip(names, is_word, strict=True)]).alias("x"))
    return one.select(F.inline("x")).where("n_status_values > 0")


def dominant_value(df: DataFrame, c: str, share: float = 0.05) -> DataFrame:
    """The most frequent value and its rows, if it holds ``share`` of all rows with one."""
    d = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = d.agg(F.sum("n").alias("total"))  # one row
    return d.orderBy(F.desc("n"), "value").limit(1).crossJoin(total).where(F.col("n") >= share * F.col("total")).select("value", "n")


def implied_price_outliers(df: DataFrame, revenue: str, quantity: str) -> DataFrame:
    """Rows with a price, those whose revenue by quantity lies far from the median, by deviation and by a factor of 50."""
    return _implied_prices(df, revenue, quantity).select("n", "n_off")


def _implied_prices(df: DataFrame, revenue: str, quantity: str) -> DataFrame:
    d = with_robust_z(df.select((F.col(revenue) / F.nullif(F.col(quantity), F.lit(0))).alias("value")).where("value > 0"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(_far_price(F.col("value"), F.col("med"), F.col("mad"))).alias("n_off"), F.max("med").alias("med"), F.max("mad").alias("mad"))


def _far_price(value: Column, med: Column, mad: Column) -> Column:
    return (F.lit(0.6745) * F.abs(value - med) / F.nullif(mad, F.lit(0.0)) > 15) & ~value.between(med / 50, med * 50)


def delivery_delays(df: DataFrame, ordered: str | Column, delivered: str | Column, most: int = 365) -> DataFrame:
    """Rows, those delivered before they were ordered, and those delivered over ``most`` days later."""
    return counts(df, **_delays(_c(ordered), _c(delivered), most))


def short_span(df: DataFrame, c: str, least: int = 56) -> DataFrame:
    """Days between the first and the last date, and whether these are too few for a trend."""
    return df.agg(F.datediff(F.max(c), F.min(c)).cast("long").alias("span_days")).withColumn("short", F.col("span_days") < least)


def shipping_excess(df: DataFrame, revenue: str | Column, shipping: str | Column) -> DataFrame:
    """Rows, and those whose shipping costs over twice their amount."""
    return counts(df, n_over=_excess(_c(revenue), _c(shipping)))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _delays(ordered: Column, delivered: Column, most: int) -> dict[str, Column]:
    return {"n_before": delivered < ordered, "n_late": F.datediff(delivered, ordered) > most}


def _excess(revenue: Column, shipping: Column) -> Column:
    return (revenue > 0) & (shipping > 2 * revenue)


def table_score(df: DataFrame, issues: list[Issue], columns: list[ColumnProfile] | None = None) -> float:
    """``score`` of a table: completeness from its null words, the other shares from the rows that issues touch."""
    if columns is None:
        r = df.agg(F.count(F.lit(1)), *[F.count_if(is_null_token(F.col(c).cast("string"))) for c in df.columns]).first()
        n, rates = max(1, r[0]), [x / max(1, r[0]) for x in r[1:] if x < r[0]]
    else:
        n, rates = max((p.n for p in columns), default=1) or 1, [p.null_rate for p in columns if p.role != "empty"]
    touched = [1 - min(1.0, sum(i.n_affected for i in issues if i.id in ids) / n) for ids in SHARES.values()]
    return score(1 - sum(rates) / max(1, len(rates)), *touched, issues)


def score(completeness: float, consistency: float, validity: float, uniqueness: float, issues: list[Issue]) -> float:
    """Mean of the four shares in per cent less the issues' penalties, from 0 to 100."""
    mean = 100 * (completeness + consistency + validity + uniqueness) / 4
    return max(0.0, min(100.0, mean - sum(PENALTY.get((i.policy, i.severity), 0) for i in issues)))


def label(value: float) -> str:
    return next(name for least, name in ((90, "excellent"), (75, "good"), (55, "fair"), (30, "poor"), (-1, "critical")) if value >= least)


def issues_frame(spark: SparkSession, issues: list[Issue]) -> DataFrame:
    return spark.createDataFrame([(i.id, i.severity, i.policy, ",".join(i.columns), i.n_affected) for i in issues], "id string, severity string, policy string, columns string, n_affected long")


def details_frame(spark: SparkSession, issues: list[Issue]) -> DataFrame:
    """(id, columns, options, details, samples): what can be decided, what was found in particular (JSON), and the first rows that show it."""
    rows = [(i.id, ",".join(i.columns), list(i.options), json.dumps(i.details, ensure_ascii=False, default=str, sort_keys=True), [str(x) for x in i.samples]) for i in issues]
    return spark.createDataFrame(rows, "id string, columns string, options array<string>, details string, samples array<string>")


#: Rows of an issue, groups of spellings and pairs of labels that are shown.
SHOWN_ROWS, SHOWN_GROUPS, SHOWN_PAIRS = 10, 10, 15


def first_rows(df: DataFrame, row_id: str, conditions: dict[int, Column], most: int = SHOWN_ROWS) -> dict[int, tuple]:
    """The smallest row ids that meet each condition, from one pass; a task sends at most ``most`` of each."""
    if not conditions:
        return {}
    hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]))
    d = df.select(F.col(f"`{row_id}`").alias("id"), F.explode(hits).alias("k")).where("id IS NOT NULL")
    d = d.withColumn("place", F.row_number().over(W.partitionBy("k").orderBy("id"))).where(F.col("place") <= most)
    out: dict[int, list] = {}
    for r in d.collect():
        out.setdefault(r.k, []).append(r.id)
    return {k: tuple(sorted(x)) for k, x in out.items()}


def _first_ids(df: DataFrame, row_id: str) -> tuple:
    return tuple(r[0] for r in df.select(F.col(f"`{row_id}`")).orderBy(F.col(f"`{row_id}`")).limit(SHOWN_ROWS).collect())


class _Found:
    """Issues as they are found, each with the condition that its rows meet, if rows show it."""

    def __init__(self):
        self.issues: list[Issue] = []
        self.rows: dict[int, Column] = {}

    def __call__(self, id_: str, k: int, *names: str, rows: Column | None = None, samples: tuple = (), **details) -> None:
        severity, policy, default = RULES[id_]
        if rows is not None:
            self.rows[len(self.issues)] = rows
        self.issues.append(Issue(id_, severity, policy, names, int(k), default, {x: v for x, v in details.items() if v is not None}, samples))


def diagnose(df: DataFrame, mapping: dict[str, str | None], row_id: str, as_of: str, columns: list[ColumnProfile] | None = None, notes: tuple[str, ...] = (), values: DataFrame | None = None) -> list[Issue]:
    """All issues of a table, by severity and share, with details and the first rows that show them.

    ``mapping`` names the columns of concepts, ``row_id`` a column that only
    numbers rows, ``notes`` ids that the scan of the file left. Text columns
    count as numbers and dates where their profile says so. ``columns`` and
    ``values`` are what ``profile.profiled`` gives, if it has been run. Plain
    counts come from one pass, spellings and outliers from the distinct values
    that profiles are made from; copies, order sums and amounts take one pass
    each, and one more finds the rows that are shown.
    """
    if columns is None:
        columns, values = profile.profiled(df)
    place = {p.name: k for k, p in enumerate(columns)}
    columns = [p for p in columns if p.name != row_id]
    by_name = {p.name: p for p in columns}
    mapped = {k: by_name[c] for k, c in mapping.items() if c in by_name}
    n = max((p.n for p in columns), default=None)
    n = df.count() if n is None else n
    found = _Found()
    for note in notes:
        found(note, 0)
    if n < 30:
        found("B01_no_rows", n)
    if not any(p.role == "measure" for p in columns):
        found("B02_no_measure", 0)
    if not any(p.role == "temporal" for p in columns):
        found("B03_no_date", 0)
    _from_profiles(columns, mapped, n, found)
    tests, rules, sums = _tests(df, columns, mapped, as_of)
    r = df.agg(*[F.count_if(c).alias(k) for k, c in tests.items()], *[x.alias(k) for k, x in sums.items()]).first() if tests else {}
    for key, (id_, names, most, share, about) in rules.items():
        if r[key] and r[key] > most * n and r[key] >= share * n:
            found(id_, r[key], *names, rows=tests[key], **{k: r[x] for k, x in about.items()})
    _spellings(df, columns, place, values, found)
    _outliers(df, columns, place, values, found)
    _repeated(df, mapped, row_id, found)
    if n:
        _coherence(df, mapped, n, found)
    shown = first_rows(df, row_id, found.rows)
    issues = [replace(i, samples=shown[k]) if k in shown else i for k, i in enumerate(found.issues)]
    return sorted(issues, key=lambda i: (SEVERITIES.index(i.severity), -i.n_affected / max(1, n), i.id, i.columns))


def _from_profiles(columns: list[ColumnProfile], mapped: dict[str, ColumnProfile], n: int, found) -> None:
    critical = {mapped[k].name for k in ("revenue", "order_date", "order_id") if k in mapped}
    missing_in = lambda p: F.col(f"`{p.name}`").isNull() if p.native else F.coalesce(is_null_token(F.col(f"`{p.name}`")), F.lit(True))
    for p in columns:
        if p.role == "empty":
            found("S05_empty_columns", n, p.name)
        elif p.role == "constant":
            found("S06_constant_columns", n, p.name)
        elif missing := p.n - p.n_present:
            if p.name in critical:
                found("N01_critical_missing", missing, p.name, rows=missing_in(p))
            elif p.null_rate > 0.05:
                found("N02_high_null_rate" if p.null_rate > 0.5 else "N03_moderate_missing", missing, p.name, rows=missing_in(p), null_pct=round(100 * p.null_rate, 1))
        if p.role in ("categorical", "boolean_flag") and p.n_unique > 200:
            found("C06_high_cardinality", n, p.name, n_values=p.n_unique)
        if p.role == "measure" and not p.native:
            if p.currency_share > 0.5:
                found("M04_currency_symbols", round(p.currency_share * p.n_present), p.name)
            if p.comma_share > 0.5 and p.comma_confidence < 0.7:
                found("M07_ambiguous_decimal", n, p.name)
        if p.role == "temporal":
            if not p.native and p.n_present - p.n_read > 0.02 * n:
                found("T01_unparsable", p.n_present - p.n_read, p.name, rows=~missing_in(p) & p.moment().isNull())
            if not p.native and p.n_day_month > 0.8 * p.n_present and p.day_order == "undecided":
                found("T02_ambiguous_format", n, p.name)
            if p.first is not None and (p.last - p.first).days < 56:
                found("T06_insufficient_span", n, p.name, days=(p.last - p.first).days)


def _tests(df: DataFrame, columns: list[ColumnProfile], mapped: dict[str, ColumnProfile], as_of: str) -> tuple[dict[str, Column], dict[str, tuple], dict[str, Column]]:
    """Conditions to be counted; by their names (id, columns, share that must be passed, share that must be reached, details); and the aggregates of details."""
    tests: dict[str, Column] = {}
    rules: dict[str, tuple] = {}
    sums: dict[str, Column] = {}

    def put(id_: str, condition: Column, *names: str, over: float = 0.0, least: float = 0.0, **details: Column) -> None:
        key = f"t{len(tests)}"
        tests[key], rules[key] = condition, (id_, names, over, least, {k: f"{key}_{k}" for k in details})
        sums.update({f"{key}_{k}": x for k, x in details.items()})

    either = lambda tests_: reduce(lambda a, b: a | b, tests_, F.lit(False))
    texts = [p for p in columns if p.type in ("text", "boolean") and not p.native]
    put("S07_total_rows", either(is_total(F.col(f"`{p.name}`")) for p in columns if not p.native))
    put("X01_test_rows", either(has_test_word(F.col(f"`{p.name}`")) for p in texts if p.role in ("categorical", "identifier", "high_cardinality_cat", "text")))
    for p in columns:
        if p.role == "temporal":
            t = p.moment()
            future = t > F.lit(as_of).cast("timestamp_ntz")
            put("T03_future_dates", future, p.name, latest=F.date_format(F.max(F.when(future, t)), "yyyy-MM-dd"))
            put("T04_absurd_dates", F.year(t) < 1990, p.name, earliest=F.date_format(F.min(t), "yyyy-MM-dd"))
        elif p.role == "measure":
            x = p.number()
            put("M01_negative", x < 0, p.name, total=F.sum(F.when(x < 0, x)))
            put("M02_zero_values", x == 0, p.name, least=0.01)
        elif p.role in ("categorical", "boolean_flag") and not p.native:
            v = F.col(f"`{p.name}`")
            put("C01_whitespace", v != trimmed(v), p.name)
            put("C05_null_placeholders", v.isNotNull() & is_null_token(v), p.name)
    status = mapped.get("order_status") or next((p for p in columns if p.role == "categorical" and not p.native and _has_status(p)), None)
    revenue = mapped["revenue"].number() if "revenue" in mapped else None
    if status:
        v = F.col(f"`{status.name}`").cast("string")
        # Distinct values of a column that is a category, and so has few.
        put("X02_cancelled_orders", is_cancelled(v), status.name, statuses=F.array_sort(F.collect_set(F.when(is_cancelled(v), v))) if status.n_unique <= 200 else F.lit(None).cast("string"))
        if "order_status" in mapped and revenue is not None:
            put("R06_cancelled_with_amount", is_cancelled_exactly(v) & (revenue > 0), status.name, mapped["revenue"].name, over=0.01, amount=F.sum(F.when(is_cancelled_exactly(v) & (revenue > 0), revenue)))
    if "order_date" in mapped and "delivery_date" in mapped:
        a, b = mapped["order_date"], mapped["delivery_date"]
        late = _delays(a.moment(), b.moment(), 365)
        put("R02_delivery_before_order", late["n_before"], a.name, b.name)
        put("R03_delivery_delay", late["n_late"], a.name, b.name, over=0.005, longest_days=F.max(F.datediff(b.moment(), a.moment())))
    if revenue is not None and "shipping_cost" in mapped:
        put("R07_shipping_exceeds_amount", _excess(revenue, mapped["shipping_cost"].number()), mapped["shipping_cost"].name, mapped["revenue"].name, over=0.005)
    return tests, rules, sums


def _has_status(p: ColumnProfile) -> bool:
    from tallymark.functions.text import CANCELLED
    from tallymark.operators.profile import normal

    return any(normal(v) in CANCELLED for v in p.top)


def _labels(df: DataFrame, names: dict[str, int], values: DataFrame | None) -> DataFrame | None:
    """(c, spelling, n) of the trimmed values of some columns, from their distinct values, or from the table for those that have long ones or if there are none."""
    parts, scanned = [], set(names) if values is None else set()
    if values is not None:
        own = values.where(F.col("c").isin(list(names.values())))
        long_ = {r.c for r in own.where("long IS NOT NULL").select("c").distinct().collect()}  # at most one a column
        scanned = {x for x, k in names.items() if k in long_}
        if short := [k for x, k in names.items() if x not in scanned]:
            parts.append(own.where(F.col("c").isin(short)).select("c", trimmed(F.col("v")).alias("spelling"), "n"))
    parts += [df.select(F.lit(names[x]).alias("c"), trimmed(F.when(~is_null_token(F.col(f"`{x}`")), F.col(f"`{x}`"))).alias("spelling"), F.lit(1).cast("long").alias("n")) for x in sorted(scanned)]
    d = reduce(DataFrame.unionByName, parts)
    return d.where("spelling IS NOT NULL").groupBy("c", "spelling").agg(F.sum("n").alias("n"))


def _spellings(df: DataFrame, columns: list[ColumnProfile], place: dict[str, int], values: DataFrame | None, found, most: int = 200) -> None:
    """C02, C03 and C04 of all columns with at most ``most`` values, which is what makes them categories."""
    names = {p.name: place[p.name] for p in columns if p.role in ("categorical", "boolean_flag") and not p.native and p.n_unique <= most}
    if not names:
        return
    labels = _labels(df, names, values)
    case, accent, typo = grouped_spellings(labels, F.lower), by_accents(labels), label_pairs(labels, most)
    none = F.lit(None).cast("string")
    # As many rows as there are labels at most, in columns of at most ``most`` labels.
    rows = reduce(DataFrame.unionByName, [case.select(F.lit("C02_case_variants").alias("id"), "c", "spelling", "best", "n", none.alias("k")), accent.select(F.lit("C03_accent_variants").alias("id"), "c", "spelling", "best", "n", "k"), typo.select(F.lit("C04_near_duplicates").alias("id"), "c", F.col("variant").alias("spelling"), F.col("probable").alias("best"), "n", none.alias("k"))]).collect()
    for id_ in ("C02_case_variants", "C03_accent_variants", "C04_near_duplicates"):
        for name, k in names.items():
            own = [r for r in rows if r.id == id_ and r.c == k]
            if not own:
                continue
            other = {r.spelling: r.n for r in own if r.spelling != r.best}
            groups: dict[str, set] = {}
            for r in own:
                groups.setdefault(r.best, set()).add(r.spelling)
            total = len(groups) if id_ == "C03_accent_variants" else sum(other.values())
            pairs = sorted((r.best, r.spelling) for r in own)[:SHOWN_PAIRS]
            more = {"pairs": [list(x) for x in pairs]} if id_ == "C04_near_duplicates" else {"groups": {b: sorted(x) for b, x in sorted(groups.items())[:SHOWN_GROUPS]}}
            found(id_, total, name, rows=trimmed(F.col(f"`{name}`")).isin(list(other)), **more)


def _outliers(df: DataFrame, columns: list[ColumnProfile], place: dict[str, int], values: DataFrame | None, found) -> None:
    """M03 of all measures: their median deviations in one job, then one count; both over distinct values where there are any."""
    measures = [p for p in columns if p.role == "measure" and p.n_read > 20 and p.median is not None]
    if not measures:
        return
    if values is None:
        off = [F.abs(p.number() - F.lit(p.median)) for p in measures]
        mads = list(df.sparkSession.range(1).select(*[exact_median(df.select(x.alias("x")), "x").scalar().alias(f"m{k}") for k, x in enumerate(off)]).first())
    else:
        middle = F.coalesce(*[F.when(F.col("c") == place[p.name], F.lit(float(p.median))) for p in measures])
        own = values.where(F.col("c").isin([place[p.name] for p in measures])).select("c", F.abs(F.col("x") - middle).alias("off"), "n")
        of = {r.c: r.m for r in exact_medians(own, ["c"], "off", weight="n").collect()}
        mads = [of.get(place[p.name]) for p in measures]
    tests = {k: (F.lit(0.6745) * F.abs(p.number() - F.lit(p.median)) / F.lit(mad) > 10) & (F.abs(p.number()) > 20 * p.median) for k, (p, mad) in enumerate(zip(measures, mads, strict=True)) if mad}
    if not tests:
        return
    r = df.agg(*[F.count_if(c).alias(f"t{k}") for k, c in tests.items()], *[F.max(F.when(c, measures[k].number())).alias(f"x{k}") for k, c in tests.items()]).first()
    for k, c in tests.items():
        if r[f"t{k}"]:
            found("M03_extreme_outliers", r[f"t{k}"], measures[k].name, rows=c, largest=r[f"x{k}"], median=measures[k].median)


def _repeated(df: DataFrame, mapped: dict[str, ColumnProfile], row_id: str, found) -> None:
    """D01, D02, D03 and X03: whole rows by their hashes, orders, keys, and the most frequent customer."""
    rest = [c for c in df.columns if c != row_id]
    own = df.select(row_hash(rest).alias("h"), *[F.col(f"`{p.name}`").alias(k) for k, p in mapped.items()])
    copies = own.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    if k := copies.agg(F.sum(F.col("n") - 1)).first()[0]:
        found("D01_exact_duplicates", k, samples=_first_ids(exact_duplicates(df, row_id), row_id))
    if "order_id" in mapped:
        rows = own.where("order_id IS NOT NULL").groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("u")).where("n > 1")
        r = rows.agg(F.sum("n").alias("lines"), F.sum(F.col("n") - F.col("u")).alias("copies"), F.count(F.lit(1)).alias("orders")).first()
        if r.copies:
            again = exact_duplicates(df, row_id).where(F.col(f"`{mapped['order_id'].name}`").isNotNull())
            found("D02_id_duplicates", r.copies, mapped["order_id"].name, samples=_first_ids(again, row_id), orders=r.orders)
        elif r.lines:
            found("D02_multiline_orders", r.lines, mapped["order_id"].name, orders=r.orders)
    keys = ("customer_id", "order_date", "revenue")
    if all(k in mapped for k in keys):
        # Of rows with equal keys all but one are repeats; of these, whole copies of another row aren't near ones.
        groups = own.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("u"))
        if k := groups.agg(F.sum(F.col("u") - 1)).first()[0]:
            found("D03_near_duplicates", k, *(mapped[x].name for x in keys), samples=_first_ids(near_duplicates(df, [mapped[x].name for x in keys], row_id), row_id))
    if "customer_id" in mapped and mapped["customer_id"].n_present > 50:
        top = dominant_value(df, mapped["customer_id"].name, 0.05).collect()
        if top and mapped["customer_id"].n_unique > 1:
            c = mapped["customer_id"].name
            found("X03_internal_orders", top[0].n, c, rows=F.col(f"`{c}`") == F.lit(top[0].value), customer=top[0].value, rows_of_it=top[0].n)


def _coherence(df: DataFrame, mapped: dict[str, ColumnProfile], n: int, found) -> None:
    """R01, R04 and R05, which compare amounts."""
    has = lambda *k: all(x in mapped for x in k)
    names = lambda *k: [mapped[x].name for x in k]
    if not has("revenue"):
        return
    amounts = df.select(*[p.number().alias(k) for k, p in mapped.items() if p.type == "numeric"], *[F.col(f"`{mapped[k].name}`").alias(f"{k}_key") for k in ("order_id",) if k in mapped])
    if has("quantity", "unit_price"):
        d = amounts
        if has("discount"):
            top = d.agg(F.max("discount")).first()[0] or 0
            d = d.withColumn("discount", F.coalesce(F.col("discount") / (100 if top > 1.5 else 1), F.lit(0.0)))
        else:
            d = d.withColumn("discount", F.lit(0.0))
        r = amount_mismatch(d, "revenue", "quantity", "unit_price", "discount").first()
        if r.n_off > 0.005 * n:
            x = {k: mapped[k].number() for k in ("revenue", "quantity", "unit_price", "discount") if k in mapped}
            rest = 1 - F.coalesce(x["discount"] / (100 if top > 1.5 else 1), F.lit(0.0)) if has("discount") and r.n_discounted < r.n_plain else F.lit(1.0)
            found("R01_amount_mismatch", r.n_off, *names("quantity", "unit_price", "revenue"), rows=_off(x["revenue"], x["quantity"] * x["unit_price"] * rest), with_discount=r.n_discounted < r.n_plain)
    if has("order_id", "order_total"):
        wrong = order_totals(amounts.where("order_id_key IS NOT NULL"), "order_id_key", "order_total", "revenue")
        r = wrong.agg(F.count(F.lit(1)).alias("k"), F.min("order_id_key").alias("first")).first()
        if r.k:
            found("R04_total_mismatch", r.k, *names("order_id", "order_total"), first_order=r.first)
    if has("quantity") and not has("unit_price"):
        r = _implied_prices(amounts.where("quantity > 0"), "revenue", "quantity").first()
        if r.n > 30 and r.n_off > 0.002 * n:
            x, q = mapped["revenue"].number(), mapped["quantity"].number()
            price = F.when((q > 0) & (x / F.nullif(q, F.lit(0)) > 0), x / F.nullif(q, F.lit(0)))
            found("R05_implied_price_outlier", r.n_off, *names("quantity", "revenue"), rows=_far_price(price, F.lit(r.med), F.lit(r.mad)), usual_price=r.med)
