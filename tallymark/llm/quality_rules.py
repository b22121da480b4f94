"""Quality rules: repetition counts within a text, and lines that many documents of a host share.

Lines are normalised and hashed; for each host the distinct documents of a
line are counted, copies of one text counting once. A line is above the limit
if it stands in more than ``MIN_TEXTS`` texts of its host and in more than
``MAX_SHARE`` of them, so the limit grows with the host. Such lines are
removed, except from the first text that holds them, and a document that is
depleted by that is rejected. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import SPACE, let, stored, table

#: A line is above the limit if more distinct texts of its host than this hold it ...
MIN_TEXTS = 5
#: ... and more than this share of them.
MAX_SHARE = 0.05
#: A document is depleted if less than this share of its words is left, or fewer than MIN_WORDS.
MIN_LEFT = 0.2
MIN_WORDS = 20
MAX_REPEATED = 0.30
WINDOW = 8


def _repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more, the first find included.

    Each word is hashed once, and a window by the hashes of its words. Window
    hashes are sorted with their places; neighbours with equal hashes give the
    places of repeated windows, and the union of these is measured by the
    steps between them. Time is n log n in the length of the text.
    """
    zero = F.lit(0).cast("long")

    def places(s: Column) -> Column:  # s: (hash, place), sorted
        pairs = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))

    def covered(p: Column) -> Column:  # p: places, sorted
        steps = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(window)))
        return F.when(F.size(p) == 0, zero).otherwise(F.aggregate(steps, zero, lambda t, x: t + x) + window)

    def repeats(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(F.sort_array(pairs), lambda s: let(places(s), covered)))

    def hashes(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    by_word = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) <= window, zero).otherwise(let(let(by_word, hashes), repeats))


def text_columns(text: Column) -> Column:
    """A struct of the base counts of a text (null as empty), all long, and of its lines that hold a word.

    A line has its place ``at`` from 1 among all lines, its number of words,
    and the hash ``h`` of its words in lower case, one space apart.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("at"), x.alias("line"), F.array_remove(F.split(x, SPACE), "").alias("w")))
    normal = lambda x: F.struct(x["at"].alias("at"), F.xxhash64(F.lower(F.array_join(x["w"], " "))).alias("h"), F.size(x["w"]).cast("long").alias("words"))

    def counts(solid: Column, words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(solid) - F.size(F.array_distinct(F.transform(solid, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.transform(solid, normal).alias("lines"),
        )

    return let(F.filter(lines, lambda x: F.size(x["w"]) > 0), lambda s: let(F.flatten(F.transform(s, lambda x: x["w"])), lambda w: counts(s, w)))


def without_lines(text: Column, places: Column) -> Column:
    """The text less the lines at ``places`` (sorted, from 1), which may be null; other lines stay as they are."""

    def rest(lines: Column) -> Column:
        cuts = F.concat(F.array(F.lit(0)), places, F.array(F.size(lines) + 1))
        return let(cuts, lambda c: F.flatten(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.slice(lines, a + 1, b - a - 1))))

    return F.when(places.isNull(), text).otherwise(F.array_join(let(F.split(text, "\n"), rest), "\n"))


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_texts: int, max_share: float, min_left: float) -> DataFrame:
    """The rows of ``quality_rules``, and in ``removed_lines`` the sorted places of the lines above the limit, null if none."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    d = d.select("doc_id", "host", text_columns(F.col("text")).alias("b"), F.xxhash64("text").alias("sig"), F.xxhash64(F.lit("2"), "text").alias("sig2"))
    d = stored(d.select("doc_id", "host", "b.*", "sig", "sig2"), "rules-lines")
    solid = d.where("n_words > 0")
    texts = solid.groupBy("host", "sig", "sig2").agg(F.min("doc_id").alias("first_id"), F.min_by("lines", "doc_id").alias("lines"))
    distinct = texts.select("host", "sig", "sig2", "first_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    common = distinct.groupBy("host", "h").agg(F.count(F.lit(1)).alias("texts"), F.min_by(F.struct("sig", "sig2"), "first_id").alias("keeper")).where(F.col("texts") > min_texts)
    hosts = solid.select("host", "sig", "sig2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_texts"))
    common = common.alias("c").join(hosts.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("texts") > F.lit(max_share) * F.col("host_texts")).select("c.host", "h", "keeper")
    per_line = solid.select("host", "sig", "sig2", F.explode("lines").alias("x")).select("host", "sig", "sig2", "x.*")
    on = F.col("l.host").eqNullSafe(F.col("c.host")) & (F.col("l.h") == F.col("c.h"))
    hit = per_line.alias("l").join(common.alias("c"), on).where(F.struct("l.sig", "l.sig2") != F.col("c.keeper")).select("l.host", "l.sig", "l.sig2", "l.at", "l.words")
    # Copies of a text bring the same lines again.
    removed = hit.distinct().groupBy("host", "sig", "sig2").agg(F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_list("at")).alias("removed_lines"))
    on = F.col("d.host").eqNullSafe(F.col("r.host")) & (F.col("d.sig") == F.col("r.sig")) & (F.col("d.sig2") == F.col("r.sig2"))
    out = d.alias("d").join(removed.alias("r"), on, "left").select("d.*", F.coalesce("n_removed_words", F.lit(0)).cast("long").alias("n_removed_words"), "removed_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < F.lit(min_left) * F.col("n_words")) | (left < MIN_WORDS)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: the base counts, words removed with shared lines, base_failed and kept.

    ``kept`` is false where the base rules fail (fewer than 20 words, or more
    than 30 % of words in repeated windows), or where the lines left after
    removal hold less than ``min_left`` of the words or fewer than 20. Lines
    are counted over distinct texts of a host, so copies of a text never
    condemn it, and a line above the limit stays in the text with the smallest
    id that holds it. Null and empty texts have no words and fail the base
    rules. A null host is a host of its own. Rows with equal ids are counted
    and returned as they are; they share the removals of their texts. Texts
    are read whole, however long. An empty table gives no rows. Other columns
    are not read. The texts themselves without these lines come from
    ``kept_documents``.
    """
    out = _judged(docs, id_col, text_col, host_col, min_texts, max_share, min_left)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def kept_documents(docs: DataFrame, *, min_texts: int = MIN_TEXTS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that the rules keep, with all their columns, their texts without the lines above the limit.

    Rows are told apart by id, host and text, so repeated rows stay as often
    as they occur; nulls are as in ``quality_rules``. Columns of any name are
    carried as they are.
    """
    key = F.struct("doc_id", F.col("source").cast("string").alias("host"), F.xxhash64("text").alias("t"), F.xxhash64(F.lit("2"), "text").alias("t2"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"))
    stay = _judged(named.select("k", "row.text", "row.source"), "k", "text", "source", min_texts, max_share, min_left).where("kept")
    stay = stay.select(F.col("doc_id").alias("stay"), "removed_lines").dropDuplicates(["stay"])
    both = named.join(stay, F.col("k").eqNullSafe(F.col("stay")))
    text = without_lines(F.col("row.text"), F.col("removed_lines"))
    return both.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS solid FROM d),
win AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 6, 1))) AS i, words FROM w),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM win),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(coalesce(nxt - i, 8), 8)) AS n_repeat_words FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
b AS (SELECT w.*, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(solid) - len(list_distinct(solid)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
l AS (SELECT doc_id, host, text, trim(regexp_replace(lower(unnest(solid)), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM w),
f AS (SELECT host, text, min(doc_id) AS first_id FROM d GROUP BY host, text),
t AS (SELECT host, count(*) AS host_texts FROM f WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY host),
c AS (SELECT host, line, min(first_id) AS keeper FROM l JOIN f USING (host, text) JOIN t USING (host) GROUP BY host, line, host_texts HAVING count(DISTINCT first_id) > 5 AND count(DISTINCT first_id) > 0.05 * host_texts),
r AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n_removed FROM l JOIN f USING (host, text) JOIN c USING (host, line) WHERE first_id <> keeper GROUP BY doc_id),
o AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(n_removed, 0) AS n_removed_words FROM b LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words - n_removed_words < 0.2 * n_words OR n_words - n_removed_words < 20) AS kept,
  n_removed_words::BIGINT AS n_removed_words FROM o
"""
