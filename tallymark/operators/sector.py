"""Business sector of a shop from the labels of its products, by counts of words of a lexicon."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.functions.text import strip_accents

#: Common product words by sector, without accents; callers pass fuller lists.
LEXICON = {
    "mode": "robe chemise pantalon chaussure jupe manteau veste pull dress shirt shoes jacket skirt jeans".split(),
    "beaute": "parfum creme maquillage shampoo cosmetic serum vernis mascara savon lotion perfume lipstick".split(),
    "telephonie": "telephone smartphone coque chargeur ecouteur phone charger earphone simcard".split(),
    "informatique": "ordinateur clavier souris imprimante ecran disque laptop keyboard monitor printer tablet router".split(),
    "maison": "meuble lampe coussin rideau tapis vase assiette furniture lamp curtain kitchen candle mug".split(),
    "alimentation": "cafe chocolat biscuit the huile epice confiture coffee chocolate snack sauce honey wine".split(),
    "sport": "velo fitness raquette ballon maillot bike running football yoga tent ski".split(),
    "enfants": "jouet bebe poupee peluche couche toy baby puzzle doll stroller".split(),
    "livres": "livre roman cahier bande dessinee stylo book novel notebook pencil magazine".split(),
    "bijoux": "bague collier bracelet montre boucle necklace earring watch ring pendant".split(),
    "animaux": "chien chat croquette laisse litiere dog kitten aquarium leash hamster".split(),
    "bricolage": "perceuse outil peinture marteau visserie drill tool paint hammer screwdriver ladder".split(),
}


def is_label(c: Column) -> Column:
    """Whether a value is a name and not a product code."""
    v = F.trim(c)
    letters, digits = F.regexp_count(v, F.lit(r"\p{L}")), F.regexp_count(v, F.lit(r"\p{Nd}"))
    code = (digits > 0) & ((letters <= digits) | (~F.contains(v, F.lit(" ")) & (F.length(v) <= 10)))
    return F.coalesce((F.length(v) > 2) & (letters >= 3) & ~code, F.lit(False))


def labels(df: DataFrame, c: str, most: int = 60) -> DataFrame:
    """The names among the ``most`` frequent values."""
    text = df.select(F.col(c).cast("string").alias("label")).where("label IS NOT NULL")
    top = text.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(most)
    return top.where(is_label(F.col("label"))).select("label")


def scores(names: DataFrame, lexicon: dict[str, tuple[str, ...]] | DataFrame | None = None) -> DataFrame:
    """(sector, score, words): how often words that begin with a keyword occur, where any does.

    A lexicon of any size comes as a table (sector, word): keywords are single
    words, and meet the beginnings of the labels' words by a join.
    """
    t = strip_accents(F.lower("label"))
    if isinstance(lexicon, DataFrame):
        known = lexicon.select("sector", strip_accents(F.lower(F.trim("word"))).alias("word")).where("word <> ''").distinct()
        w = names.select(F.explode(F.regexp_extract_all(t, F.lit(r"(?U)(\w+)"))).alias("w"))
        starts = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda n: F.substring(F.col("w"), F.lit(1), n))).alias("word"))
        d = starts.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(known, "word")
        return d.groupBy("sector").agg(F.sum("n").alias("score"), F.array_sort(F.collect_set("word")).alias("words"))
    words = [(s, w) for s, ws in (lexicon or LEXICON).items() for w in ws]
    hits = F.array(*[F.struct(F.lit(s).alias("sector"), F.lit(w).alias("word"), F.regexp_count(t, F.lit(r"\b" + re.escape(w))).alias("n")) for s, w in words])
    d = names.select(F.explode(F.filter(hits, lambda x: x["n"] > 0)).alias("h"))
    return d.groupBy("h.sector").agg(F.sum("h.n").alias("score"), F.array_sort(F.collect_set("h.word")).alias("words"))


def sector(names: DataFrame, lexicon: dict[str, tuple[str, ...]] | DataFrame | None = None) -> DataFrame:
    """The leading sector, its confidence (how far it leads the second), and whether it needs a check.

    Under 0.35 the shop sells several kinds of goods and the sector is null. No row where no word is found.
    """
    d = scores(names, lexicon).select("sector", F.col("score").cast("double").alias("n"), "words")
    order = W.partitionBy().orderBy(F.desc("n"), "sector")  # a row for each sector of the lexicon
    d = d.withColumn("second", F.lead("n").over(order)).withColumn("place", F.row_number().over(order)).where("place = 1")
    lead = F.greatest(F.lit(0.0), (F.col("n") / (F.col("n") + F.col("second")) - 0.5) * 2.4) * F.when(F.col("n") < 3, 0.6).otherwise(1.0)
    sure = F.when(F.col("second").isNull(), F.when(F.col("n") >= 3, 0.95).otherwise(0.6)).otherwise(F.least(F.lit(0.95), lead))
    d = d.withColumn("confidence", F.round(sure, 2))
    return d.select(F.when(F.col("confidence") >= 0.35, F.col("sector")).alias("sector"), "confidence", (F.col("confidence") < 0.7).alias("to_confirm"), "words")
