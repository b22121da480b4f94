"""Checks the numbers that a text names against computed facts.

Texts are cut at their numbers by one regular expression; a number is then
looked up among the facts of its report by a logarithmic bucket as wide as the
tolerance, so the join is one of equal keys and not of all pairs.
"""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.functions.text import strip_accents

TOLERANCE = 0.005
# Numbers that no one measures, words of dates and durations, terms that a shopkeeper wouldn't know.
SMALL_NUMBERS = (0, 1, 2, 3, 4, 5, 10, 100)
MONTHS = ("jan", "fev", "mar", "avr", "mai", "juin", "juil", "aou", "sep", "oct", "nov", "dec")
DAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")
PERIODS = ("jour", "semaine", "mois", "trimestre", "annee", "heure")
JARGON = (
    "rfm", "cohorte", "pareto", "corrélation", "correlation", "écart-type", "ecart-type", "médiane", "mediane", "régression", "regression", "r²", "r2", "z-score", "quantile", "percentile",
    "variance", "outlier", "anomalie", "dataframe", "agrégation", "agregation", "cardinalité", "imputation", "linéaire", "lineaire", "significatif", "p-value",
)

#: A word of time, without accents: a month's start, a day, a period in one or many.
TIME_WORDS = rf"(?iu)\b(({'|'.join(MONTHS)})\w*|{'|'.join(DAYS)}|({'|'.join(PERIODS)})s?)\b"
_SPACES = r"[ \u00A0\u202F]"
#: A run of digits, in which a point or comma stands between digits, and a space between one to three digits and a group of three.
_GROUPING = rf"(?<=(?<!\d)\d{{1,3}}){_SPACES}(?=\d{{3}}(?!\d))"
NUMBER = rf"(?<![\d.,])[-−+]?\d(?:(?:[.,]|{_GROUPING})?\d)*"
#: A number written with cents, which ``cents_count`` takes for an amount whatever its value; thousands may be parted once.
CENTS = rf"^[-−+]?(\d+|\d{{1,3}}([.,]|{_SPACES})\d{{3}})[.,]\d\d$"
_OPEN, _SHUT = "\u0001", "\u0002"


def number_value(c: Column) -> Column:
    """The value of a run of digits, by its points and commas.

    A comma alone is a decimal sign, as a point alone is. Of both the last is
    the decimal sign; several of one kind stand between thousands.
    """
    c = F.regexp_replace(F.translate(c, "−+", "-"), _SPACES, "")
    points, commas = F.regexp_count(c, F.lit(r"\.")), F.regexp_count(c, F.lit(","))
    last_comma = F.length(F.substring_index(c, ",", -1)) < F.length(F.substring_index(c, ".", -1))
    decimal_comma = F.when((points > 0) & (commas > 0), last_comma).otherwise(commas == 1)
    plain = F.when(decimal_comma, F.translate(c, ",.", ".")).otherwise(F.regexp_replace(c, ",", ""))
    return F.when((commas == 0) & (points > 1), F.regexp_replace(c, r"\.", "")).otherwise(plain).try_cast("double")


def numbers(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(report, position, number, value, context) of each number; ISO dates have none. Null and empty texts give no row."""
    t = F.regexp_replace(F.regexp_replace(F.col(text_col), f"[{_OPEN}{_SHUT}]", " "), r"\b\d{4}-\d{2}-\d{2}\b", "··········")
    t = F.regexp_replace(t, r"\b\d{4}-\d{2}\b", "·······")
    cut = texts.select(F.col(id_col).alias("report"), F.monotonically_increasing_id().alias("__row"), F.col(text_col).alias("__text"), F.split(F.regexp_replace(t, f"({NUMBER})", f"{_OPEN}$1{_SHUT}"), _OPEN).alias("__parts"))
    d = cut.select("report", "__row", "__text", F.posexplode("__parts").alias("__k", "__part"))
    size = F.length(F.translate("__part", _SHUT, ""))
    before = F.sum(size).over(W.partitionBy("report", "__row").orderBy("__k").rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("position", F.coalesce(before, F.lit(0)).cast("long")).where("__k > 0")
    d = d.withColumn("number", F.substring_index("__part", _SHUT, 1))
    start = F.greatest(F.lit(0), F.col("position") - 40)
    context = F.substring(F.col("__text"), (start + 1).cast("int"), (F.col("position") + F.length("number") + 25 - start).cast("int"))
    return d.select("report", "position", "number", number_value(F.col("number")).alias("value"), context.alias("context")).where("value IS NOT NULL")


def ignored(value: Column, context: Column, number: Column | None = None) -> Column:
    """Why a number isn't a measure (small, year, duration) by its value, or null. With ``number``, one written with cents always is a measure."""
    whole = value % 1 == 0
    why = F.when(value.isin(*map(float, SMALL_NUMBERS)), "small").when(value.between(1900, 2100) & whole, "year").when(whole & (value <= 60) & strip_accents(context).rlike(TIME_WORDS), "duration")
    return why if number is None else F.when(~number.rlike(CENTS), why)


def _bucket(v: Column) -> Column:
    return F.when(v == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(v)) / math.log1p(2 * TOLERANCE)).cast("long"))


def verified(found: DataFrame, facts: DataFrame, cents_count: bool = False) -> DataFrame:
    """``found`` with status (ignored, verified, unverified) and the path of a fact that matches.

    ``facts`` has report, path and value. A fact also vouches for its absolute
    value and its rounded value. Of several the first path counts. With
    ``cents_count`` 2000.00 is an amount and not a year.
    """
    v = F.col("value")
    more = facts.where("value IS NOT NULL AND NOT isnan(value)").select("report", "path", F.explode(F.array_distinct(F.array(v, F.abs(v), F.bround(v, 0)))).alias("fact"))
    # A bucket is twice as wide as the tolerance, so a match is in it or in one beside it; zero matches zero alone.
    fact = F.col("fact")
    steps = F.when(fact == 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda x: _bucket(fact) + x))
    keyed = more.select("report", "path", "fact", F.signum("fact").alias("sign"), F.explode(steps).alias("bucket")).groupBy("report", "sign", "bucket", "fact").agg(F.min("path").alias("path"))
    d = found.withColumn("why", ignored(v, F.col("context"), F.col("number") if cents_count else None)).withColumn("sign", F.signum("value")).withColumn("bucket", _bucket(v))
    near = (d.alias("a").join(keyed.alias("b"), ["report", "sign", "bucket"])
        .where(F.abs(F.col("a.value") - F.col("fact")) <= TOLERANCE * F.abs("fact")).groupBy("report", "value").agg(F.min("path").alias("path")))
    out = d.join(near, ["report", "value"], "left")
    status = F.when(F.col("why").isNotNull(), "ignored").when(F.col("path").isNotNull(), "verified").otherwise("unverified")
    return out.select("report", "position", "number", "value", status.alias("status"), "why", F.when(F.col("why").isNull(), F.col("path")).alias("path"))


def fidelity(checked: DataFrame) -> DataFrame:
    """Per report: numbers named, verified, unverified, ignored, and verified over checked (1 if none is)."""
    n = {s: F.count_if(F.col("status") == s) for s in ("verified", "unverified", "ignored")}
    d = checked.groupBy("report").agg(F.count(F.lit(1)).alias("n_named"), *[c.alias(f"n_{s}") for s, c in n.items()])
    return d.withColumn("fidelity", F.coalesce(F.try_divide("n_verified", F.col("n_verified") + F.col("n_unverified")), F.lit(1.0)))


def jargon(c: Column, terms: tuple[str, ...] = JARGON) -> Column:
    """The terms that stand in a text as whole words; spellings that differ by accents count once."""
    t = F.translate(strip_accents(F.lower(c)), "²³", "23")
    plain = lambda w: "".join(x for x in unicodedata.normalize("NFKD", w) if not unicodedata.combining(x))
    first = {plain(w): w for w in reversed(terms)}
    return F.filter(F.array(*[F.when(t.rlike(rf"\b\Q{p}\E\b"), F.lit(w)) for p, w in first.items()][::-1]), lambda x: x.isNotNull())


def stems(c: Column) -> Column:
    """Distinct first five letters of the words of five letters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(strip_accents(F.lower(c)), F.lit(r"(?u)(\w{5,})")), lambda w: F.substring(w, 1, 5)))


def derived_action(action: Column, reference: Column) -> Column:
    """Whether an action shares two stems or more with a reference action."""
    return F.size(F.array_intersect(stems(action), stems(reference))) >= 2


def overall(checked: DataFrame) -> DataFrame:
    """One row over all reports: reports, numbers checked, verified and not, fidelity, and the reports that are wholly verified."""
    per = fidelity(checked)
    sums = per.agg(F.count(F.lit(1)).alias("n_reports"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_named", "n_verified", "n_unverified")], F.count_if(F.col("fidelity") == 1).alias("n_faithful"))
    return sums.withColumn("fidelity", F.coalesce(F.try_divide("n_verified", F.col("n_verified") + F.col("n_unverified")), F.lit(1.0)))
