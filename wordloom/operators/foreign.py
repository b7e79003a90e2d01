"""Foreign words: routing, described readings, German and French pattern adaptation (FOR-2 .. FOR-6, FOR-14 .. FOR-18, AG-9, AG-10).

Spelling rules are rows of a table: a rule holds at a place of a word when the letters on its left and on its right match, and
then shifts the point there, or adds one. Everything is column expressions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import phonology as P
from wordloom.functions import prosody

# Letters of the two languages, their spelling rules, and the units a Slovak ending meets at the end of a German base.
VOWELS = "aeiouyäöüàâæéèêëîïôœùûüÿ"
LETTERS = {"german": "abcdefghijklmnopqrstuvwxyzäöüß'", "french": "abcdefghijklmnopqrstuvwxyzàâäæçéèêëîïôöœùûüÿ'"}
UNITS = "tsch|dsch|sch|ch|ck|tz|ph|th|ng|dz|dž"
V = f"[{VOWELS}]"
UNLESS_PREFIX = "^(?!(?:re|ré|dé|pré|mé)$)"


class Rule(NamedTuple):
    """Where these letters stand before and after a place, its point moves by shift letters, or a point is added."""

    language: str
    name: str
    before: str
    after: str
    shift: int = 0


MOVES = (
    Rule("german", "de_tz_single_affricate", f"{V}t$", f"^z{V}", -1),
    Rule("german", "de_three_consonants", f"{V}[lmnr]s$", f"^t{V}", -1),
    Rule("french", "fr_two_consonants", f"{UNLESS_PREFIX}.*{V}$", f"^[bcdfgptv][lr]{V}", 1),
    Rule("french", "fr_two_consonants", f"{UNLESS_PREFIX}.*{V}$", f"^[cpt]h[lr]{V}", 2),
)
ADDITIONS = (
    Rule("french", "fr_hiatus", "é$", "^[aoâ]"),
    Rule("french", "fr_hiatus", "[ao]$", "^é"),
)
#: The first vowel of such a French word has a point behind it that the patterns leave out.
FRENCH_OPENING = f"^{V}[bcdfgptv][lr](?!e){V}"
# End of fixed values.

CHANGE, INTS = "struct<before:int,after:int,rule:string>", "array<int>"


def _either(rules: tuple[Rule, ...], language: Column, lower: Column, place: Column, value) -> Column:
    """value(rule) of the first rule that holds at the place, else null."""
    left, right = F.substring(lower, F.lit(1), place), F.substring(lower, place + 1, F.length(lower))
    out = F.lit(None)
    for rule in reversed(rules):
        out = F.when((language == rule.language) & left.rlike(rule.before) & right.rlike(rule.after), value(rule)).otherwise(out)
    return out


def adapt(word: Column, language: Column, raw: Column, seams: Column | None = None) -> Column:
    """struct(native, points, changes, error): pattern points (found with margins of 1) adapted by spelling rules (FOR-4).

    Known seams are kept. A point that a rule moves beyond the margins of two letters goes without a replacement. A null word
    has no points and no error; points are sorted.
    """
    lower = F.replace(F.lower(word), F.lit("’"), F.lit("'"))
    none = F.array().cast(INTS)
    fixed = none if seams is None else F.coalesce(seams.cast(INTS), none)
    places = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    inner = lambda x: F.filter(x, lambda p: (p >= 2) & (p <= F.length(word) - 2))
    opening = F.when((language == "french") & lower.rlike(FRENCH_OPENING), F.array(F.lit(1))).otherwise(none)
    found = F.array_union(F.coalesce(raw.cast(INTS), none), opening)
    seam_changes = F.transform(inner(F.array_sort(F.array_except(fixed, found))), lambda p: F.struct(F.lit(None).cast("int").alias("before"), p.alias("after"), F.lit("verified_morpheme").alias("rule")))
    move = lambda p: _either(MOVES, language, lower, p, lambda r: F.struct(p.alias("before"), (p + r.shift).cast("int").alias("after"), F.lit(r.name).alias("rule")))
    moved = F.filter(F.transform(F.array_sort(F.array_except(found, fixed)), move), lambda m: m.isNotNull())
    reached = inner(F.transform(moved, lambda m: m["after"]))
    kept = F.array_union(F.array_except(F.array_union(found, fixed), F.transform(moved, lambda m: m["before"])), reached)
    add = lambda p: _either(ADDITIONS, language, lower, p, lambda r: F.struct(F.lit(None).cast("int").alias("before"), p.cast("int").alias("after"), F.lit(r.name).alias("rule")))
    added = F.filter(F.transform(F.array_except(inner(places), kept), add), lambda m: m.isNotNull())
    shown = F.transform(moved, lambda m: F.struct(m["before"].alias("before"), F.when((m["after"] >= 2) & (m["after"] <= F.length(word) - 2), m["after"]).alias("after"), m["rule"].alias("rule")))
    error = F.when(~F.coalesce(language.isin(*LETTERS), F.lit(False)), "BAD_LANGUAGE")
    for name, letters in LETTERS.items():
        error = error.when((language == name) & ~lower.rlike(f"^[{letters}]*$"), "UNSUPPORTED_SPELLING")
    error = error.when(F.exists(fixed, lambda p: (p <= 0) | (p >= F.length(word))), "BAD_MORPHEME_POINT")
    fine = word.isNotNull() & error.isNull()
    changes = F.concat(seam_changes.cast(f"array<{CHANGE}>"), shown.cast(f"array<{CHANGE}>"), added.cast(f"array<{CHANGE}>"))
    return F.struct(
        F.when(fine, F.array_sort(inner(found))).otherwise(none).alias("native"),
        F.when(fine, F.array_sort(F.array_distinct(F.concat(inner(kept), F.transform(added, lambda m: m["after"]))))).otherwise(none).alias("points"),
        F.when(fine, changes).otherwise(F.array().cast(f"array<{CHANGE}>")).alias("changes"),
        F.when(word.isNotNull(), error).alias("error"),
    )


def _vowel_first(text: Column) -> Column:
    return F.lower(text).rlike(f"^[{''.join(x for x in P.VOWEL_LIKE if len(x) == 1)}]")


def inflected_german(stem: Column, ending: Column, stem_points: Column) -> Column:
    """Points of a German base with a Slovak ending (FOR-6).

    A consonant ending leaves the base alone. A vowel ending takes the base's last unit of consonants with it, or the later
    ones where there are several; ng closes its syllable, and an h after the last vowel is only a mark of length.
    """
    lower, seam, whole = F.lower(stem), F.length(stem), F.length(stem) + F.length(ending)
    last_vowel = F.length(F.regexp_extract(lower, f"^(?:.*{V})?", 0))
    tail = last_vowel + F.when(F.substring(lower, last_vowel + 1, F.lit(1)) == "h", 1).otherwise(0)
    units = F.regexp_extract_all(F.substring(lower, tail + 1, F.length(lower)), F.lit(f"{UNITS}|."), F.lit(0))
    crossing = F.when(F.size(units) == 0, seam).when(F.size(units) == 1, tail).otherwise(tail + F.length(F.get(units, F.lit(0))))
    crossing = F.when(lower.endswith("ng") & (crossing == seam - 2), seam).otherwise(crossing)
    inside = F.transform(prosody.written_points(ending), lambda p: seam + p)
    joined = F.concat(F.filter(stem_points, lambda p: p < tail), F.array(crossing), inside)
    apart = F.concat(stem_points, F.array(seam), inside)
    points = F.when(_vowel_first(ending), joined).otherwise(apart)
    return F.array_sort(F.array_distinct(F.filter(points, lambda p: (p >= 2) & (p <= whole - 2))))


def described_points(word: Column, parts: Column, ending: Column) -> Column:
    """struct(points, contextual) of a reading whose parts map spellings to sound roles (FOR-3).

    parts: array of parts, each an array of struct(spelling, role). Each part divides as its roles do, parts meet at seams,
    and a vowel ending divides with the last part.
    """
    size = lambda part: F.aggregate(part, F.lit(0), lambda n, u: n + F.length(u["spelling"]))
    vowel = (F.length(ending) > 0) & _vowel_first(ending)

    def own(part: Column, n: Column) -> Column:
        begin = F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda at, p: at + size(p))
        after = lambda i: begin + size(F.slice(part, F.lit(1), i + 1))
        places = F.concat(F.array(begin), F.flatten(F.transform(part, lambda u, i: F.array_repeat(after(i), F.length(u["role"])))))
        end, last = begin + size(part), n == F.size(parts) - 1
        spoken = F.array_join(F.transform(part, lambda u: u["role"]), "")
        joins = last & vowel
        places = F.when(joins, F.concat(places, F.transform(F.sequence(F.lit(1), F.greatest(F.length(ending), F.lit(1))), lambda k: end + k))).otherwise(places)
        points = F.transform(prosody.written_points(F.when(joins, F.concat(spoken, ending)).otherwise(spoken)), lambda p: F.get(places, p))
        apart = last & (F.length(ending) > 0) & ~vowel
        points = F.when(~last | apart, F.concat(points, F.array(end))).otherwise(points)
        return F.when(apart, F.concat(points, F.transform(prosody.written_points(ending), lambda p: end + p))).otherwise(points)

    found = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(parts, own)), lambda p: p != F.length(word) - 1)))
    edge = F.filter(found, lambda p: (p == 1) & _vowel_first(word))
    return F.struct(F.array_except(found, edge).alias("points"), edge.alias("contextual"))


def routed(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """word, language, stem, ending: the only candidate of the only flagged language, if its stem and ending are the evidence's (FOR-2).

    candidates(word, language, stem, ending); evidence(word, language, stem, ending, flagged).
    """
    flagged = evidence.filter("flagged").groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("language", "stem", "ending")).alias("e")).filter("n = 1").select("word", "e.*")
    fits = candidates.join(flagged, ["word", "language", "stem", "ending"]).groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("language", "stem", "ending")).alias("r"))
    return fits.filter("n = 1").select("word", "r.*")


def adapter_statistics(rows: DataFrame) -> DataFrame:
    """Counts over rows(language, v) with v an adapted division (AG-10)."""
    native, points = F.col("v.native"), F.col("v.points")
    return rows.groupBy("language").agg(
        F.count("*").alias("types"),
        F.count_if(F.size(native) > 0).alias("native_with_breaks"),
        F.count_if(F.size(points) > 0).alias("adapted_with_breaks"),
        F.count_if(native != points).alias("changed_words"),
        F.sum(F.size(F.array_except(points, native))).alias("added_points"),
        F.sum(F.size(F.array_except(native, points))).alias("removed_points"),
    )


def rule_histogram(rows: DataFrame) -> DataFrame:
    return rows.select("language", F.explode("v.changes.rule").alias("rule")).groupBy("language", "rule").agg(F.count("*").alias("n"))


def evidence_row(rows: DataFrame) -> DataFrame:
    """The two status columns of rows(form, language, phones, complete, error, points): what failed stays to be tried again (FOR-14)."""
    spoken = F.when(F.col("error").isNotNull(), "error").when(F.col("phones").isNotNull(), "generated").otherwise("pending")
    proposed = F.when(F.col("error").isNotNull(), "error").when(F.col("phones").isNull(), "pending").when(~F.col("complete"), "incomplete").when(F.size("points") > 0, "candidate").otherwise("experimental")
    return rows.withColumn("pronunciation_status", spoken).withColumn("proposal_status", proposed)


def inventory_problems(rows: DataFrame) -> DataFrame:
    """form, problem of an evidence table (FOR-16): repeated forms, divisions with other letters, statuses that contradict the columns."""
    again = rows.groupBy("form").count().filter("count > 1").select("form", F.lit("repeated").alias("problem"))
    letters = rows.filter(F.replace("proposed_hyphenation", F.lit("·"), F.lit("")) != F.col("form")).select("form", F.lit("letters").alias("problem"))
    state = rows.filter(((F.col("pronunciation_status") == "generated") & F.col("phones").isNull()) | ((F.col("pronunciation_status") == "error") & F.col("error").isNull())).select("form", F.lit("status").alias("problem"))
    return again.union(letters).union(state)


def reprojection_plan(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """form, before, after of proposals that a new projection would change; reviewed forms are left out (FOR-18)."""
    rows = stored.filter(~F.coalesce("reviewed", F.lit(False))).select("form", F.col("division").alias("before")).join(fresh.select("form", F.col("division").alias("after")), "form")
    return rows.filter(~F.col("before").eqNullSafe(F.col("after")))


def routing_metrics(rows: DataFrame) -> DataFrame:
    """Per language: words, routed, right, wrong, unrouted, accuracy and capture of rows(language, routed) (AG-9)."""
    right, none = F.count_if(F.col("routed") == F.col("language")), F.count_if(F.col("routed").isNull())
    out = rows.groupBy("language").agg(F.count("*").alias("words"), right.alias("right"), F.count_if(F.col("routed") != F.col("language")).alias("wrong"), none.alias("unrouted"))
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    return out.withColumn("accuracy", share(F.col("right"), F.col("right") + F.col("wrong"))).withColumn("capture", share(F.col("right"), F.col("words")))
