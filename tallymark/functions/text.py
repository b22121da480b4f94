"""Text and date functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing value, of total rows, of test rows, of orders without revenue; signs of currencies; forms of dates.
NULL_TOKENS = ("", "na", "n/a", "nan", "none", "null", "-", "--", "?", "#n/a", "#na", "inconnu", "non renseigne", "vide", "nil", "undefined")
TOTAL_TOKENS = ("total", "totaux", "somme", "sous-total", "sous total", "subtotal", "grand total", "cumul", "moyenne")
TEST_TOKENS = ("test", "essai", "demo", "dummy", "aaa", "xxx", "zzz", "azerty", "qwerty", "toto", "sample", "exemple")
CANCELLED = (
    "annule", "annulee", "cancelled", "canceled", "refunded", "rembourse", "remboursee", "unavailable", "failed", "echec", "returned", "returning", "retourne", "retournee",
    "void", "rejected", "rejete", "rejetee", "refuse", "refusee", "lost in transit", "perdu", "non livre", "undelivered", "chargeback", "litige", "dispute",
)
CURRENCY = r"[€$£¥]|R\$|EUR|USD|XOF|FCFA|CFA"
DATE_FORMATS = (
    "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "M.d.yyyy", "d/M/yy", "M/d/yy", "d-M-yy", "M-d-yy",
    "yyyy-M-d H:m:s", "d/M/yyyy H:m", "M/d/yyyy H:m", "yyyy-M-d'T'H:m:s", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
)

#: Accented Latin letters and their plain ones, up to U+017F.
_PLAIN = {chr(k): unicodedata.normalize("NFKD", chr(k))[0] for k in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(k))) > 1}


def strip_accents(c: Column) -> Column:
    return F.translate(c, "".join(_PLAIN), "".join(_PLAIN.values()))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^[\s\h]+|[\s\h]+$", "")


def is_null_token(c: Column) -> Column:
    return c.isNull() | F.lower(trimmed(c)).isin(*NULL_TOKENS)


def bare_number(c: Column) -> Column:
    """A number's text without currency and spaces."""
    return F.regexp_replace(F.regexp_replace(c, f"(?i){CURRENCY}", ""), "[ \\t\\r\\n  ]", "")


def numeric_text(c: Column, decimal_comma: bool) -> Column:
    """A number from text: currency and spaces go, the thousands sign goes, the decimal sign becomes a point; else null."""
    c = bare_number(c)
    c = F.regexp_replace(F.regexp_replace(c, r"\.(?=\d{3}(\D|$))", ""), ",", ".") if decimal_comma else F.regexp_replace(c, ",", "")
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


def comma_tests(c: Column) -> dict[str, Column]:
    """What tells a decimal comma from one between thousands: a short or long tail, a zero before it; groups, a point after it."""
    b = bare_number(c)
    return {"n_tail": b.rlike(r",(\d{1,2}|\d{4,})$"), "n_zero_first": b.rlike(r"^-?0,\d+$"), "n_groups": b.rlike(r"^-?\d{1,3}(,\d{3}){2,}$"), "n_comma_point": b.rlike(r",\d{3}\.\d+")}


def comma_evidence(c: Column) -> list[Column]:
    """Counts of the values that meet each of ``comma_tests``."""
    return [F.count_if(x).alias(k) for k, x in comma_tests(c).items()]


def comma_decision(n_tail: int, n_zero_first: int, n_groups: int, n_comma_point: int) -> tuple[str, float]:
    """What the comma is in a whole column, and how sure that is; without evidence a decimal sign, half sure."""
    decimal, thousands = n_tail + n_zero_first, n_groups + n_comma_point
    if not decimal + thousands:
        return "decimal", 0.5
    most = max(decimal, thousands)
    return "decimal" if decimal >= thousands else "thousands", round(most / (decimal + thousands), 2)


def is_cancelled(c: Column) -> Column:
    """A status that is a word for an order without revenue, or has one of six letters or more at the start of a word."""
    s = strip_accents(F.lower(trimmed(c)))
    return F.coalesce(s.isin(*CANCELLED) | s.rlike(r"\b(" + "|".join(t for t in CANCELLED if len(t) >= 6) + ")"), F.lit(False))


def is_cancelled_exactly(c: Column) -> Column:
    return F.coalesce(strip_accents(F.lower(trimmed(c))).isin(*CANCELLED), F.lit(False))


def has_test_word(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"(^|[^\p{L}\p{N}_])(" + "|".join(TEST_TOKENS) + r")([^\p{L}\p{N}_]|$)"), F.lit(False))


def is_total(c: Column) -> Column:
    return F.coalesce(strip_accents(F.lower(trimmed(c))).isin(*TOTAL_TOKENS), F.lit(False))


def day_first_tests(c: Column) -> dict[str, Column]:
    """Whether a text is a date in d/m or m/d form, and whether it can only be one of them."""
    parts = r"^(\d{1,2})[/.-](\d{1,2})[/.-]"
    first, second = (F.regexp_extract(trimmed(c), parts, k).try_cast("int") for k in (1, 2))
    return {"n_dates": first.isNotNull(), "n_day_first": first > 12, "n_month_first": second > 12}


def day_first_evidence(c: Column) -> list[Column]:
    """Counts of the values that meet each of ``day_first_tests``."""
    return [F.count_if(x).alias(k) for k, x in day_first_tests(c).items()]


def day_order(n_values: int, n_dates: int, n_day_first: int, n_month_first: int) -> tuple[str, float]:
    """dayfirst, monthfirst or undecided for a whole column, and how sure: only a number over 12 on one side decides."""
    if n_dates < max(5, 0.5 * n_values) or bool(n_day_first) == bool(n_month_first):
        return "undecided", 0.0
    n = n_day_first or n_month_first
    return "dayfirst" if n_day_first else "monthfirst", min(0.99, 0.7 + n / n_dates)


def ranked_formats(order: str) -> list[str]:
    """``DATE_FORMATS``, those that contradict the order of day and month last."""
    month, day = (lambda f: f[0] == "M" and f[1] != "M"), (lambda f: f[0] == "d" and " MMMM" not in f)
    against = {"dayfirst": month, "monthfirst": day}.get(order, lambda f: False)
    return sorted(DATE_FORMATS, key=against)


#: How a text of any of ``DATE_FORMATS`` begins. A text that doesn't isn't tried, as each try that fails is costly.
_DATE_BEGINS = r"^(\d{1,4}([-/.]\d{1,2}[-/.]|\s\p{L})|\p{L}{3,}\.? \d)"


def read_date(c: Column, form: str) -> Column:
    """The text as a timestamp by one form, or null."""
    t = trimmed(c)
    return F.try_to_timestamp(F.when(t.rlike(_DATE_BEGINS), t), F.lit(form))


def parsed_date(c: Column, formats: tuple[str, ...]) -> Column:
    """The first of the formats that reads the text, as a timestamp without zone."""
    return F.coalesce(*[read_date(c, f).cast("timestamp_ntz") for f in formats])


def compact(c: Column) -> Column:
    """A number as people read it: 1.2M, 34k, 56."""
    size = F.abs(c)
    return F.when(size >= 1e6, F.concat(F.format_number(c / 1e6, 1), F.lit("M"))).when(size >= 1e4, F.concat(F.format_number(c / 1e3, 0), F.lit("k"))).otherwise(F.format_number(c, 0))
