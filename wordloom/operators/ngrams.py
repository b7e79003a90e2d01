"""Language evidence from character n-grams (LNG-*, AG-3 .. AG-7, DD-1)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import text as X

SIZES = (3, 4, 5)
ALPHA, LEAST = 0.05, 5


def grams(word: Column, sizes=SIZES, marked: bool = True) -> Column:
    """All n-grams of ^word$ (or of the bare word), with repeats."""
    text = F.concat(F.lit("^"), word, F.lit("$")) if marked else word

    def of(n: int) -> Column:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(text, i, F.lit(n)))

    every = [of(n) for n in sizes]
    return F.concat(*every)


def unique_types(types: DataFrame) -> DataFrame:
    """Types(word, lang) that only one language has (DD-1)."""
    once = types.groupBy("word").agg(F.min("lang").alias("lang"), F.max("lang").alias("last")).filter("lang = last")
    return once.select("word", "lang")


def family_bucket(word: Column, salt: str) -> Column:
    """train, calibration or test by the first five letters without marks (LNG-10): 70, 15 and 15 of 100 hashes."""
    n = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.substring(X.folded(word), 1, 5)), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(n < 70, "train").when(n < 85, "calibration").otherwise("test")


def _languages(rows: DataFrame) -> list[str]:
    return sorted(r["lang"] for r in rows.select("lang").filter("lang is not null").distinct().collect())  # one row a language


def router_weights(types: DataFrame) -> DataFrame:
    """gram, lang, weight: additive log probabilities of grams that occur LEAST times in all (LNG-11, AG-5).

    A language's total counts all its grams, also the rare ones that get no weight. A gram's counts of all languages stand in
    one row, so one exchange does.
    """
    langs = _languages(types)
    if not langs:
        return types.select(F.lit("").alias("gram"), "lang", F.lit(0.0).alias("weight")).limit(0)
    own = [f"c{i}" for i in range(len(langs))]
    rows = types.select("lang", F.explode(grams(F.col("word"))).alias("gram"))
    counted = rows.groupBy("gram").agg(*[F.count_if(F.col("lang") == x).alias(c) for c, x in zip(own, langs, strict=True)])
    totals = counted.agg(*[F.sum(c).alias(f"n{c}") for c in own])
    kept = counted.filter(sum((F.col(c) for c in own), F.lit(0)) >= LEAST).crossJoin(F.broadcast(totals))  # one row
    weight = lambda c: F.round(F.log((F.col(c) + ALPHA) / (F.col(f"n{c}") + 2 * ALPHA)), 6)
    cells = F.array(*[F.struct(F.lit(x).alias("lang"), weight(c).alias("weight")) for c, x in zip(own, langs, strict=True)])
    return kept.select("gram", F.explode(cells).alias("x")).select("gram", "x.lang", "x.weight")


def router_scores(words: DataFrame, weights: DataFrame) -> DataFrame:
    """word, lang, score of distinct words: sums over all grams with their repeats; words without a known gram have no row (LNG-1).

    A gram's weights of all languages are joined as one row.
    """
    langs = _languages(weights)
    if not langs:
        return words.select("word", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score")).limit(0)
    own = [f"w{i}" for i in range(len(langs))]
    wide = weights.groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == x, F.col("weight").cast("decimal(18,6)"))).alias(c) for c, x in zip(own, langs, strict=True)])
    rows = words.select("word", F.explode(grams(F.lower("word"))).alias("gram")).join(wide, "gram")
    sums = rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in own])
    cells = F.array(*[F.struct(F.lit(x).alias("lang"), F.round(c, 6).cast("double").alias("score")) for c, x in zip(own, langs, strict=True)])
    return sums.select("word", F.explode(cells).alias("x")).select("word", "x.lang", "x.score").filter("score is not null")


def detected(scores: DataFrame, margin: float = 0.0) -> DataFrame:
    """word, lang of the best language; null where the lead is under the margin, ties go to the first by name (LNG-2, WN-9)."""
    order = Window.partitionBy("word").orderBy(F.desc("score"), "lang")
    rows = scores.withColumn("n", F.row_number().over(order)).withColumn("lead", F.col("score") - F.lead("score").over(order))
    return rows.filter("n = 1").select("word", F.when(F.coalesce("lead", F.lit(margin)) >= margin, F.col("lang")).alias("lang"))


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted, n and the actual class's accuracy (AG-3)."""
    cells = rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("actual")
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).over(own)
    return cells.withColumn("accuracy", right / F.sum("n").over(own))


def profile(types: DataFrame, language: str, other: str, sizes=SIZES, marked: bool = True, least: int = 3) -> DataFrame:
    """gram, weight: log odds of types holding a gram in the one language against the other (LNG-12, AG-6)."""
    rows = types.filter(F.col("lang").isin(language, other))
    n = rows.groupBy().agg(F.count_if(F.col("lang") == language).alias("n1"), F.count_if(F.col("lang") == other).alias("n0"))
    held = rows.select("lang", F.explode(F.array_distinct(grams(F.col("word"), sizes, marked))).alias("gram"))
    counted = held.groupBy("gram").agg(F.count_if(F.col("lang") == language).alias("c1"), F.count_if(F.col("lang") == other).alias("c0")).filter(F.col("c1") + F.col("c0") >= least)
    odds = F.log((F.col("c1") + 0.5) / (F.col("n1") + 1)) - F.log((F.col("c0") + 0.5) / (F.col("n0") + 1))
    return counted.crossJoin(F.broadcast(n)).select("gram", F.round(odds, 6).alias("weight"))  # n: one row


def evidence(words: DataFrame, weights: DataFrame, threshold: float, support: int = 2, coverage: float = 0.5, sizes=SIZES, marked: bool = True) -> DataFrame:
    """word, score, support, coverage, flagged: the mean weight of a word's known distinct features (LNG-3 .. LNG-6)."""
    rows = words.select("word", F.array_distinct(grams(F.lower("word"), sizes, marked)).alias("f"))
    rows = rows.select("word", F.size("f").alias("features"), F.explode_outer("f").alias("gram")).join(weights, "gram", "left")
    out = rows.groupBy("word").agg(F.max("features").alias("features"), F.count("weight").alias("support"), F.sum(F.col("weight").cast("decimal(18,6)")).cast("double").alias("total"))
    out = out.select("word", F.when(F.col("support") > 0, F.round(F.col("total") / F.col("support"), 6)).otherwise(-100.0).alias("score"), "support", F.round(F.col("support") / F.greatest("features", F.lit(1)), 6).alias("coverage"))
    return out.withColumn("flagged", (F.col("score") >= threshold) & (F.col("support") >= support) & (F.col("coverage") >= coverage))


def informative_letters(types: DataFrame, language: str, other: str, least: int = 10, ratio: float = 5.0) -> DataFrame:
    """letter, c1, c0: letters whose rate in the one language is ratio times the other's (AG-7)."""
    rows = types.filter(F.col("lang").isin(language, other)).select("lang", F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter <> ''")
    n = types.groupBy().agg(F.count_if(F.col("lang") == language).alias("n1"), F.count_if(F.col("lang") == other).alias("n0"))
    counted = rows.groupBy("letter").agg(F.count_if(F.col("lang") == language).alias("c1"), F.count_if(F.col("lang") == other).alias("c0")).crossJoin(F.broadcast(n))
    return counted.filter((F.col("c1") >= least) & ((F.col("c0") == 0) | (F.col("c1") * F.col("n0") >= ratio * F.col("c0") * F.col("n1")))).select("letter", "c1", "c0")


def binary_metrics(rows: DataFrame, actual: Column, flagged: Column) -> DataFrame:
    """Precision, recall and flag rate of a flag against a class (AG-4)."""
    true = F.count_if(actual & flagged)
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    return rows.agg(true.alias("hits"), share(true, F.count_if(flagged)).alias("precision"), share(true, F.count_if(actual)).alias("recall"), F.avg(flagged.cast("double")).alias("flag_rate"))


def readings(words: DataFrame, stems: DataFrame, endings: DataFrame) -> DataFrame:
    """word, stem, ending, language: a stem itself, else every cut with a listed ending and a stem that inflects (FOR-1)."""
    whole = words.join(stems, F.lower("word") == F.col("stem")).select("word", "stem", F.lit("").alias("ending"), "language")
    cut = words.join(whole.select("word"), "word", "left_anti").filter(F.length("word") > 3)
    cut = cut.select("word", F.explode(F.sequence(F.lit(3), F.length("word") - 1)).alias("at"))
    cut = cut.select("word", F.substring(F.lower("word"), F.lit(1), F.col("at")).alias("stem"), F.substring(F.lower("word"), F.col("at") + 1, F.length("word")).alias("ending"))
    return whole.union(cut.join(endings, "ending").join(stems.filter("inflects"), "stem").select("word", "stem", "ending", "language"))


@F.udf(T.StringType(), useArrow=True)
def language_key(word):
    return None if word is None else unicodedata.normalize("NFC", word).lower().replace("‐", "-")


def reviewed_language(words: DataFrame, labels: DataFrame) -> DataFrame:
    """words with language, the label of exactly this form in labels(form, language), else null (LNG-7); labels' forms are keys, each once."""
    labels = labels.select(F.col("form").alias("_form"), "language")
    return words.join(labels, language_key("word") == F.col("_form"), "left").drop("_form")
