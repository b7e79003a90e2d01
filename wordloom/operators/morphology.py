"""Morpheme seams from lexicon tables (MOR-2, 3, 5, 7, 8, 10 .. 13, 17, 19 in the form of joins), and division at them (DIV-4).

A seam lies between two listed parts of a word. Prefixes, first members, stems, suffixes and exceptions are tables, so the same
joins serve any language; a word's letters are cut at every length that a table has and met by equality. The candidates are
ordered by evidence: exact listings, then compounds, prefixes and suffixes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import phonology as P
from wordloom.functions import prosody

SEAMS = "word string, seam int, kind string"


def _cuts(words: DataFrame, parts: DataFrame, part: str, end: bool = False, rest: int = 2) -> DataFrame:
    """word, part, rest of words whose first (or last) letters are a listed part and that keep so many letters besides."""
    listed = parts.select(F.lower(part).alias("part")).distinct().filter(F.length("part") > 0)
    sizes = listed.agg(F.array_sort(F.collect_set(F.length("part"))).alias("sizes"))  # as many as there are lengths
    rows = words.select("word").distinct().crossJoin(F.broadcast(sizes)).select("word", F.explode(F.filter("sizes", lambda n: n + rest <= F.length("word"))).alias("n"))  # one row
    first, last = F.expr("left(lower(word), n)"), F.expr("right(lower(word), length(word) - n)")
    if end:
        first, last = F.expr("right(lower(word), n)"), F.expr("left(lower(word), length(word) - n)")
    return rows.select("word", first.alias("part"), last.alias("rest")).join(listed, "part").select("word", "part", "rest")


def starts_like_a_word(text: Column) -> Column:
    """A vowel, one consonant, or a cluster that may open a syllable comes first (MOR-12)."""
    onset = F.regexp_extract(F.lower(text), f"^[^{''.join(x for x in P.VOWEL_LIKE if len(x) == 1)}]*", 0)
    sounds = F.size(P.phonemes(onset))
    native = P.native_spelling(onset)
    return (onset == "") | (sounds == 1) | native.isin(*prosody.ONSETS)


def _known(cuts: DataFrame, stems: DataFrame, least: int) -> DataFrame:
    """The cuts whose rest begins with a listed stem of so many letters at least; the longest stem."""
    listed = stems.select(F.lower("stem").alias("stem")).distinct().filter(F.length("stem") >= least)
    found = _cuts(cuts.select(F.col("rest").alias("word")).distinct(), listed, "stem", rest=0).groupBy(F.col("word").alias("rest")).agg(F.max(F.length("part")).alias("size"))
    return cuts.join(found, "rest")


def prefix_seams(words: DataFrame, prefixes: DataFrame, stems: DataFrame, least: int = 3) -> DataFrame:
    """word, seam, kind: a listed prefix before a listed stem, and a second prefix inside the rest (MOR-2, MOR-3)."""
    cuts = _cuts(words, prefixes, "prefix").filter(starts_like_a_word(F.col("rest")))
    own = _known(cuts, stems, least).select("word", F.length("part").alias("seam"))
    inner = _cuts(cuts.select(F.col("rest").alias("word")).distinct(), prefixes, "prefix").select(F.col("word").alias("rest"), F.col("part").alias("second"), F.col("rest").alias("core"))
    both = _known(cuts.join(inner, "rest").select("word", F.length("part").alias("one"), (F.length("part") + F.length("second")).alias("two"), F.col("core").alias("rest")), stems, least)
    return own.union(both.select("word", "one")).union(both.select("word", "two")).select("word", "seam", F.lit("prefix").alias("kind")).distinct()


def compound_seams(words: DataFrame, members: DataFrame, heads: DataFrame, least: int = 4) -> DataFrame:
    """word, seam, kind: a listed first member before a listed head; the leftmost seam of a word (MOR-10, MOR-11, MOR-13)."""
    cuts = _known(_cuts(words, members, "form", rest=least), heads, least)
    return cuts.groupBy("word").agg(F.min(F.length("part")).cast("int").alias("seam")).select("word", "seam", F.lit("compound").alias("kind"))


def suffix_seams(words: DataFrame, suffixes: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """word, seam, kind: a listed consonant-initial ending after a stem with a vowel, listed where stems are given (MOR-5, MOR-7, MOR-8)."""
    opens = ~F.lower("part").rlike(f"^[{''.join(x for x in P.VOWEL_LIKE if len(x) == 1)}]")
    cuts = _cuts(words, suffixes, "suffix", end=True).filter(opens & (F.size(P.nuclei(P.phonemes(F.col("rest")))) > 0))
    if stems is not None:
        cuts = cuts.join(stems.select(F.lower("stem").alias("rest")).distinct(), "rest", "left_semi")
    longest = cuts.groupBy("word").agg(F.max(F.length("part")).alias("n"))
    return longest.select("word", (F.length("word") - F.col("n")).cast("int").alias("seam"), F.lit("suffix").alias("kind"))


def seams(words: DataFrame, found: list[DataFrame], listed: DataFrame | None = None) -> DataFrame:
    """word, seams of all words: those of listed(word, seams) as they stand (MOR-17), else all that the given tables hold."""
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    every = rows.groupBy("word").agg(F.array_sort(F.collect_set(F.col("seam").cast("int"))).alias("found"))
    out = words.select("word").distinct().join(every, "word", "left")
    fixed = F.lit(None).cast("array<int>")
    if listed is not None:
        out = out.join(listed.select(F.lower("word").alias("_key"), F.col("seams").alias("_fixed")), F.lower("word") == F.col("_key"), "left")
        fixed = F.col("_fixed")
    return out.select("word", F.coalesce(fixed, "found", F.array().cast("array<int>")).alias("seams"))


def divided(words: DataFrame, at: DataFrame) -> DataFrame:
    """word, preferred, variant, contextual, error of words, divided at the seams of at(word, seams) (DIV-4)."""
    rows = words.select("word").distinct().join(at, "word", "left").withColumn("v", prosody.division_udf("word", F.coalesce("seams", F.array().cast("array<int>"))))
    return rows.select("word", "v.*")


def _cheapest(word: str, cost: dict[str, float], total: float, forbidden: int = -1, longest: int = 12) -> float:
    """Cost of the cheapest segmentation into morphs, with no cut at the forbidden place."""
    best = [0.0] + [math.inf] * len(word)
    for end in range(1, len(word) + 1):
        starts = [s for s in range(max(0, end - longest), end) if s != forbidden]
        if end != forbidden and starts:
            best[end] = min(best[s] + cost.get(word[s:end], (end - s + 1) * math.log(66) + math.log(total)) for s in starts)
    return best[-1]


def priced(counts: dict[str, int]):
    """An Arrow UDF of (word, place) over a bounded lexicon of morphs: price a letter, whether a seam at the place is the cheaper
    account of the word, and whether the cheapest segmentation cuts there (MOR-19)."""
    total = max(1, sum(counts.values()))
    cost = {m: math.log(total) - math.log(n) for m, n in counts.items() if n > 0}

    @F.udf(T.StructType([T.StructField("price", T.DoubleType()), T.StructField("prefers", T.BooleanType()), T.StructField("cuts", T.BooleanType())]), useArrow=True)
    def price(word, place):
        if not word:
            return None
        w = word.lower()
        split = _cheapest(w[:place], cost, total) + _cheapest(w[place:], cost, total)
        ends, at = set(), 0
        for morph in prosody.viterbi(w, cost, total):
            at += len(morph)
            ends.add(at)
        return _cheapest(w, cost, total) / len(w), split < _cheapest(w, cost, total, place), place in ends

    return price
