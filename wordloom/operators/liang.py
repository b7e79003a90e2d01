"""Liang patterns as relations: matching, learning, splitting, numerals (LIA-*, JN-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as X


#: Pattern rows and exceptions up to which a side is broadcast.
SMALL = 200_000


def fragments(words: DataFrame, longest: int, word: str = "word") -> DataFrame:
    """word, at, frag: all substrings of .word. of up to longest characters; at counts from 0."""
    padded = F.concat(F.lit("."), F.lower(word), F.lit("."))
    rows = words.select(word, padded.alias("_p"), F.explode(F.sequence(F.lit(0), F.length(padded) - 1)).alias("at"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("_p") - F.col("at")))
    return rows.select(word, "at", F.explode(F.transform(sizes, lambda n: F.substring("_p", F.col("at") + 1, n))).alias("frag"))


def possible_fragments(words: DataFrame, keys: DataFrame, small: bool) -> DataFrame:
    """word, at, frag: the substrings of .word. that have a first letter and a length of keys(frag)."""
    sizes = keys.select("frag").distinct().groupBy(F.left("frag", F.lit(1)).alias("initial")).agg(F.collect_set(F.length("frag")).alias("sizes"))
    padded = F.concat(F.lit("."), F.lower("word"), F.lit("."))
    rows = words.select("word", padded.alias("_p"), F.explode(F.sequence(F.lit(0), F.length(padded) - 1)).alias("at"))
    rows = rows.withColumn("initial", F.substring("_p", F.col("at") + 1, F.lit(1))).join(F.broadcast(sizes) if small else sizes, "initial")
    fits = F.filter("sizes", lambda n: n <= F.length("_p") - F.col("at"))
    return rows.select("word", "at", F.explode(F.transform(fits, lambda n: F.substring("_p", F.col("at") + 1, n))).alias("frag"))


def break_points(words: DataFrame, weights: DataFrame, left: int = 2, right: int = 3, exceptions: DataFrame | None = None) -> DataFrame:
    """word, points of distinct words(word) under weights(frag, off, w) (LIA-1).

    A key found at i votes its digits at slots i + off; a slot's largest vote counts, odd ones break; listed exceptions replace
    the patterns and obey the same margins. Only substrings that could be a key are cut out, so none is missed; pattern sets of
    more than SMALL rows are joined by a shuffle.
    """
    small = weights.count() <= SMALL
    votes = possible_fragments(words.select("word"), weights, small).join(F.broadcast(weights) if small else weights, "frag")
    slots = votes.groupBy("word", (F.col("at") + F.col("off")).alias("slot")).agg(F.max("w").alias("w")).filter(F.col("w") % 2 == 1)
    at = F.col("slot") - 1
    points = slots.filter((at >= F.greatest(F.lit(left), F.lit(1))) & (at <= F.length("word") - right)).groupBy("word").agg(F.array_sort(F.collect_list(at)).alias("points"))
    out = words.select("word").distinct().join(points, "word", "left").select("word", F.coalesce("points", F.array().cast("array<int>")).alias("points"))
    if exceptions is not None:
        listed = exceptions.select(F.col("word").alias("_w"), F.col("points").alias("_x"))
        out = out.join(listed, F.lower("word") == F.col("_w"), "left")
        out = out.select("word", F.when(F.col("_x").isNotNull(), X.within(F.col("_x"), F.col("word"), left, right)).otherwise(F.col("points")).alias("points"))
    return out


def agreement(rows: DataFrame, expected: str, actual: str, *by: str, beta: float = 1 / 7) -> DataFrame:
    """Words, exact rate, good, bad, missed, precision, recall, F-beta of two point columns (AG-2); empty denominators give 1."""
    e, a = F.col(expected), F.col(actual)
    count = lambda x: F.sum(F.size(x)).cast("long")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("words"),
        F.avg((e == a).cast("double")).alias("exact"),
        count(F.array_intersect(e, a)).alias("good"),
        count(F.array_except(a, e)).alias("bad"),
        count(F.array_except(e, a)).alias("missed"),
    )
    share = lambda x, y: F.when(F.col(x) + F.col(y) == 0, 1.0).otherwise(F.col(x) / (F.col(x) + F.col(y)))
    out = out.withColumn("precision", share("good", "bad")).withColumn("recall", share("good", "missed"))
    below = beta * beta * F.col("precision") + F.col("recall")
    return out.withColumn("f_beta", F.when(below == 0, 0.0).otherwise((1 + beta * beta) * F.col("precision") * F.col("recall") / below))


def is_test(word: Column, salt: str) -> Column:
    """Held out iff the first byte of sha256(salt, NUL, word) is under 51 (LIA-3)."""
    digest = F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), word), 256)
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") < 51


def exceptions(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """Words whose patterns still disagree with the target (LIA-7)."""
    return rows.filter(F.col(expected) != F.col(actual)).select("word", F.col(expected).alias("points"))


#: Levels of learning: shortest and longest fragment, weights of good and bad, threshold.
LEVELS = ((1, 2, 1, 5, 1), (2, 3, 1, 5, 1), (2, 4, 1, 3, 1), (3, 5, 1, 3, 1))


def learn(targets: DataFrame, levels=LEVELS) -> DataFrame:
    """frag, off, w learned from targets(word, points), level by level (LIA-5).

    Odd levels learn where to break, even ones where not to; at each level a fragment with a place inside is kept when good * g -
    bad * b reaches the threshold, counted over the slots that the levels before decided wrongly against those they decided right.
    """
    words = targets.select(F.lower("word").alias("word"), "points").distinct()
    slots = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("slot"), "points").filter(F.length("word") > 1)
    truth = slots.select("word", "slot", F.array_contains("points", F.col("slot")).alias("hyphen"))
    learned: DataFrame | None = None
    held: DataFrame | None = None
    for level, (shortest, longest, good, bad, threshold) in enumerate(levels, 1):
        state = truth.withColumn("value", F.lit(0))
        if learned is not None:
            votes = fragments(words, max(x[1] for x in levels)).join(learned, "frag")
            value = votes.groupBy("word", (F.col("at") + F.col("off") - 1).alias("slot")).agg(F.max("w").alias("v"))
            state = truth.join(value, ["word", "slot"], "left").select("word", "slot", "hyphen", F.coalesce("v", F.lit(0)).alias("value"))
        on = F.col("value") % 2 == 1
        # an odd level wins breaks that are missing, an even one removes wrong ones
        useful, harmful = (F.col("hyphen") & ~on, ~F.col("hyphen") & ~on) if level % 2 else (~F.col("hyphen") & on, F.col("hyphen") & on)
        state = state.select("word", "slot", useful.cast("int").alias("g"), harmful.cast("int").alias("b")).filter("g + b > 0")
        places = fragments(words, longest).filter(F.length("frag") >= shortest)
        places = places.withColumn("off", F.explode(F.sequence(F.lit(0), F.length("frag"))))
        counted = places.withColumn("slot", F.col("at") + F.col("off") - 1).join(state, ["word", "slot"]).groupBy("frag", "off").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
        kept = counted.filter((good * F.col("g") - bad * F.col("b") >= threshold) & (F.col("g") > 0)).select("frag", "off", F.lit(level).alias("w"))
        learned = kept if learned is None else learned.union(kept).groupBy("frag", "off").agg(F.max("w").alias("w"))
        learned = learned.persist()
        learned.count()  # filled before the level that it stands on goes
        if held is not None:
            held.unpersist()
        held = learned
    return learned


# Slovak number words.
UNITS = ["", "jeden", "dva", "tri", "štyri", "päť", "šesť", "sedem", "osem", "deväť"]
TEENS = ["desať", "jedenásť", "dvanásť", "trinásť", "štrnásť", "pätnásť", "šestnásť", "sedemnásť", "osemnásť", "devätnásť"]
TENS = ["", "", "dvadsať", "tridsať", "štyridsať", "päťdesiat", "šesťdesiat", "sedemdesiat", "osemdesiat", "deväťdesiat"]
# End of fixed values.


def cardinals(spark, last: int = 1000) -> DataFrame:
    """number, word for 1 .. last, written together (LIA-4)."""
    table = lambda values: F.array(*map(F.lit, values))
    n = F.col("number")
    low = n % 100
    below = F.when((low >= 10) & (low < 20), F.get(table(TEENS), (low - 10).cast("int"))).otherwise(F.concat(F.get(table(TENS), F.floor(low / 10).cast("int")), F.get(table(UNITS), (low % 10).cast("int"))))
    hundreds = F.floor(n / 100) % 10
    head = F.when(hundreds == 0, "").when(hundreds == 1, "sto").when(hundreds == 2, "dvesto").otherwise(F.concat(F.get(table(UNITS), hundreds.cast("int")), F.lit("sto")))
    return spark.range(1, last + 1).withColumnRenamed("id", "number").select("number", F.when(n == 1000, "tisíc").otherwise(F.concat(head, below)).alias("word"))
