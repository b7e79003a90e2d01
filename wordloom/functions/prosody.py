"""Syllables and line-break points of single words, and Arrow UDFs over them.

Where rule order is recursive, words are cheaper as plain Python under an Arrow UDF than as a tree of expressions. Callers apply
these to distinct forms and join the result back. Morpheme seams are an input: lexicons are parameters.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import phonology as P

# The clusters that may open a syllable.
ONSETS = frozenset("bl br bľ cl cm cn cr cv čl čm čn čr čv čľ dl dm dn dr dv dň fj fl fr fľ fň gl gn gr hl hm hml hn hr hv hľ chl chm chr chv chľ chň kl km kn kr kv kľ kň ml mr mľ pl pn pr pľ pň sl sm smr sn sr sv sľ sň šl šm šn šv šľ tl tm tr tv tľ zj zl zm zml zmr zn zr zv zľ žl žm žn žr žv žľ".split())
STOPS = frozenset("ptkbdg") | {"ť", "ď"}
NONSYLLABIC = ("rdie", "rmuc", "rmút", "rv", "lst", "lž", "ln", "lh")
# End of fixed values.

_PHONEME = re.compile("qu|" + P.PHONEME.replace("(?s).", "."), re.S)  # qu is one consonant (SYL-7)
_VOWEL_LIKE = frozenset(P.VOWEL_LIKE)
_LETTERS = frozenset(P.NATIVE_LETTERS) | frozenset(P.FOREIGN_VOWELS) | frozenset(P.FOREIGN_CONSONANTS) | {"q", "w"}
_TWINS = str.maketrans(P.FOREIGN_CONSONANTS)


@dataclass(frozen=True)
class Layout:
    """Phonemes of a word, where each starts, and which are nuclei (D4, SYL-4, SYL-9)."""

    sounds: list[str]
    offsets: list[int]
    nuclei: list[int]


def layout(word: str) -> Layout:
    found = [(m.group(), m.start()) for m in _PHONEME.finditer(word.lower())]
    sounds, offsets = [x for x, _ in found], [i for _, i in found]
    like = [x in _VOWEL_LIKE for x in sounds]
    last = len(sounds) - 1
    nuclei = [
        i
        for i, x in enumerate(sounds)
        if like[i] or x in ("ŕ", "ĺ") or (x in ("r", "l") and i < last and not like[i + 1] and (i == 0 or not like[i - 1]))
    ]
    if nuclei[:1] == [0] and word.lower().startswith(NONSYLLABIC):
        nuclei = nuclei[1:]  # an initial r or l of these roots carries no syllable (SYL-4)
    return Layout(sounds, offsets, nuclei)


def _after_stop(at: Layout, nucleus: int, start: int, stop: int) -> bool:
    """s + stop + more after a syllabic r or l divides behind the stop (SYL-5)."""
    return at.sounds[nucleus] in ("r", "l") and stop - start >= 3 and at.sounds[start] == "s" and at.sounds[start + 1] in STOPS


def onset_breaks(word: str) -> list[int]:
    """Spoken syllable boundaries (SYL-2): the longest opening cluster of up to three consonants, else the last one."""
    at, out = layout(word), []
    for a, b in zip(at.nuclei, at.nuclei[1:], strict=False):
        begin = a + 1
        if _after_stop(at, a, begin, b):
            cut = begin + 2
        else:
            cut = next((k for k in range(max(begin, b - 3), b - 1) if "".join(at.sounds[k:b]).translate(_TWINS) in ONSETS), b - 1 if b > begin else b)
        out.append(at.offsets[cut])
    return out


def written_breaks(unit: str) -> list[int]:
    """Points inside one morphological unit (DIV-5): before a lone consonant, after the first of several, between vowels."""
    at, out = layout(unit), []
    for a, b in zip(at.nuclei, at.nuclei[1:], strict=False):
        between = b - a - 1
        skip = 2 if _after_stop(at, a, a + 1, b) else min(between, 2) - 1 if between else 0
        out.append(at.offsets[a + 1 + skip])
    return out


def written_points(unit: Column) -> Column:
    """The same points as a column expression (DIV-5): for each two neighbouring nuclei, by the sounds between them."""
    sounds = F.regexp_extract_all(F.lower(unit), F.lit(f"qu|{P.PHONEME}"), F.lit(0))
    start = lambda k: F.length(F.array_join(F.slice(sounds, F.lit(1), k), ""))
    found = P.nuclei(sounds)
    silent = (F.get(found, F.lit(0)) == 0) & F.lower(unit).rlike(f"^(?:{'|'.join(NONSYLLABIC)})")
    found = F.when(silent, F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)

    def cut(a: Column, b: Column) -> Column:
        stop = F.get(sounds, a).isin("r", "l") & (b - a >= 4) & (F.get(sounds, a + 1) == "s") & F.get(sounds, a + 2).isin(*STOPS)
        return start(F.when(stop, a + 3).when(b - a >= 3, a + 2).otherwise(a + 1))

    return F.filter(F.transform(found, lambda b, i: F.when(i > 0, cut(F.get(found, i - 1), b))), lambda p: p.isNotNull())


def syllables(word: str | None) -> tuple[list[str] | None, str | None]:
    """Syllables in the word's own casing, or an error code (SYL-1)."""
    if word is None:
        return None, None
    if not word or any(c not in _LETTERS for c in word.lower()) or len(word.lower()) != len(word):
        return None, "UNSUPPORTED_SPELLING"
    cuts = [0, *onset_breaks(word), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], None


def division(word: str | None, seams: list[int] | None = None) -> tuple[list[int], list[int], list[int], str | None]:
    """Preferred, variant and contextual points, and an error code (DIV-1, DIV-4, DIV-10, DIV-11).

    seams: offsets of known morpheme boundaries; they are preferred points, and units between them divide on their own.
    """
    if word is None:
        return [], [], [], None
    if "-" in word or "‐" in word:
        points: list[int] = []
        contextual: list[int] = []
        start = 0
        pieces = re.split("[-‐]", word)
        if not all(p.isalpha() for p in pieces):
            return [], [], [], None
        for p in pieces:
            own, _, edge, error = division(p, [s - start for s in seams or [] if start < s < start + len(p)])
            if error:
                return [], [], [], error
            points += [start + x for x in own]
            contextual += [start + x for x in edge]
            start += len(p) + 1
            if start <= len(word):
                points.append(start)
        return sorted(points), [], sorted(contextual), None
    if not word.isalpha() or len(word.lower()) != len(word):
        return [], [], [], "UNSUPPORTED_SPELLING"
    if any(c not in _LETTERS - {"q", "w"} for c in word.lower()) or len(layout(word).nuclei) < 2:
        return [], [], [], None
    cuts = [0, *sorted({s for s in seams or [] if 0 < s < len(word)}), len(word)]
    points = cuts[1:-1] + [a + p for a, b in zip(cuts, cuts[1:], strict=False) for p in written_breaks(word[a:b])]
    variant = {a for a in onset_breaks(word) if any(abs(a - s) <= 2 for s in cuts[1:-1])} - set(points)
    found = set(points)
    if word[-1].lower() in _VOWEL_LIKE:
        found.discard(len(word) - 1)
        variant.discard(len(word) - 1)
    contextual = [1] if word[0].lower() in _VOWEL_LIKE and 1 in found else []
    return sorted(found - set(contextual)), sorted(variant - set(contextual)), contextual, None


def public_output(words: DataFrame) -> DataFrame:
    """word with all that division and syllables say of it (ST-6)."""
    rows = words.select("word").distinct().withColumn("d", division_udf("word", F.array().cast("array<int>"))).withColumn("s", syllables_udf("word"))
    every = F.array_sort(F.array_distinct(F.concat("d.preferred", "d.variant")))
    return rows.select("word", "d.preferred", every.alias("permissive"), F.array_sort(F.concat("d.preferred", "d.contextual")).alias("contextual"), F.coalesce("d.error", "s.error").alias("error"), F.array_join("s.syllables", "·").alias("syllables"))


def rhythmic_violations(pairs: DataFrame) -> DataFrame:
    """stem, suffix, violates of pairs(stem, suffix): whether two neighbouring syllables of the word are long (PHT-2).

    Null where the word has no syllables.
    """
    rows = pairs.select("stem", "suffix", syllables_udf(F.concat("stem", "suffix"))["syllables"].alias("_s"))
    long = F.transform("_s", P.is_long_syllable)
    both = F.exists(F.arrays_zip(F.slice(long, 1, F.size(long)).alias("a"), F.slice(long, 2, F.size(long)).alias("b")), lambda x: F.coalesce(x["a"] & x["b"], F.lit(False)))
    return rows.select("stem", "suffix", F.when(F.size("_s") > 0, both).alias("violates"))


def viterbi(word: str, cost: dict[str, float], total: float, longest: int = 12) -> list[str]:
    """Cheapest segmentation into morphs (MOR-18): known ln T - ln n, unknown (length + 1) ln 66 + ln T."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(min((best[start][0] + cost.get(word[start:end], (end - start + 1) * math.log(66) + math.log(total)), start) for start in range(max(0, end - longest), end)))
    out, end = [], len(word)
    while end:
        out.append(word[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


STRINGS, INTS = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
SYLLABLES = T.StructType([T.StructField("syllables", STRINGS), T.StructField("error", T.StringType())])
DIVISION = T.StructType([*(T.StructField(c, INTS) for c in ("preferred", "variant", "contextual")), T.StructField("error", T.StringType())])


@F.udf(SYLLABLES, useArrow=True)
def syllables_udf(word):
    return syllables(word)


@F.udf(DIVISION, useArrow=True)
def division_udf(word, seams):
    return division(word, seams)


def segmenter(counts: dict[str, int]):
    """An Arrow UDF that splits words into the morphs of a bounded lexicon."""
    total = max(1, sum(counts.values()))
    cost = {m: math.log(total) - math.log(n) for m, n in counts.items() if n > 0}

    @F.udf(STRINGS, useArrow=True)
    def segments(word):
        return None if word is None else viterbi(word, cost, total)

    return segments
