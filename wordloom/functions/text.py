"""Word and text columns: tokens, folding, casing, typed divisions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maximal runs of letters and other numbers, as the tokeniser counts them.
TOKEN = r"[\p{L}\p{Nl}\p{No}]+"
LETTERS = r"^\p{L}+$"
PROSE_WORD = r"\p{L}+(?:[-'’]\p{L}+)*"
SENTENCE_END = r"[.!?…]+"
PROSE_MARKS = r"[.,;:!?…\"„“”‚‘’»«()]"
SEPARATORS = r"[-·‐-―\s]+"
MARK = "·"
LANGUAGES = {"en": "english", "de": "german", "fr": "french", "sk": "slovak"}


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; a column used twice, or inside a lambda, is computed at every use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order (SRC-3)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def fold_pairs() -> tuple[str, str]:
    """Latin letters with marks and what is left without them, generated from the Unicode decompositions."""
    found = []
    for c in range(0xC0, 0x250):
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))
        if plain != chr(c) and len(plain) == 1:
            found.append((chr(c), plain))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def folded(form: Column) -> Column:
    """Case-folded and without marks, for Latin text (FLT-2); never use its offsets."""
    a, b = fold_pairs()
    return F.translate(F.replace(F.lower(form), F.lit("ß"), F.lit("ss")), a, b)


def matches(form: Column, term: str, mode: str = "contains") -> Column:
    """Search on the folded form (FLT-1): prefix, suffix, exact, contains, or a case-insensitive regex on the form itself."""
    if mode == "regex":
        return form.rlike(f"(?i){term}")
    key = folded(F.lit(term))
    test = {"prefix": F.startswith, "suffix": F.endswith, "contains": F.contains}
    if mode == "exact":
        return folded(form) == key
    if mode not in test:
        raise ValueError(f"unknown search mode: {mode}")
    return test[mode](folded(form), key)


def is_addable(token: Column) -> Column:
    """A token that may enter the inventory (SRC-17): letters, inner hyphens and apostrophes, 60 at most."""
    return (F.length(token) <= 60) & token.rlike(r"^\p{L}(?:[\p{L}\-'’]*\p{L})?$")


def looks_like_prose(text: Column) -> Column:
    """Running text rather than a column table (SRC-14): half of the lines with two words or more carry sentence marks."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S\s+\S") & ~F.ltrim(x).startswith("#"))
    marked = F.filter(lines, lambda x: x.rlike(PROSE_MARKS))
    return (F.size(lines) > 0) & (F.size(marked) * 2 >= F.size(lines))


def parse_marked(form: Column, typed: Column) -> Column:
    """The canonical dotted form of a typed division, null unless its letters are the form's (FLT-8)."""
    dotted = F.btrim(F.regexp_replace(F.trim(typed), SEPARATORS, MARK), F.lit(MARK))
    return F.when(F.replace(dotted, F.lit(MARK), F.lit("")) == form, dotted)


def offsets_of(marked: Column) -> Column:
    """Offsets of the marks of a dotted form."""
    marks = F.array_compact(F.transform(F.split(marked, ""), lambda x, i: F.when(x == MARK, i)))
    return F.transform(marks, lambda at, i: at - i)


def within(points: Column, form: Column, left: int = 1, right: int = 1) -> Column:
    """Points that leave left letters before and right letters after (FLT-6)."""
    if left < 1 or right < 1:
        raise ValueError("edge minima are at least 1")
    return F.filter(points, lambda p: (p >= left) & (p <= F.length(form) - right))


def parts_of(form: Column, points: Column) -> Column:
    """The pieces of a form between ascending points; its own casing is kept (FLT-9)."""
    starts = lambda ends, i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
    cut = lambda ends: F.transform(ends, lambda e, i: F.substring(form, starts(ends, i) + 1, e - starts(ends, i)))
    return bound(F.concat(points, F.array(F.length(form))), cut)


def hyphenate(form: Column, points: Column, separator: str = MARK) -> Column:
    """The form with a separator at its points (DIV-2)."""
    return F.array_join(parts_of(form, points), separator)


def divisions(form: Column, points: Column) -> Column:
    """One 'a-b' string for each point (DIV-3)."""
    return F.transform(points, lambda p: F.concat(F.substring(form, F.lit(1), p), F.lit("-"), F.substring(form, p + 1, F.length(form))))


def recase(parts: Column, form: Column) -> Column:
    """Parts with the form's casing where their lengths add up to it (FLT-9)."""

    def of(given: Column, own: Column) -> Column:
        # where the last part ends, and the parts cut so far
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("cut"))
        step = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.concat(a["cut"], F.array(F.substring(own, a["at"] + 1, F.length(x)))).alias("cut"))
        return bound(F.aggregate(given, start, step), lambda a: F.array_join(F.when(a["at"] == F.length(own), a["cut"]).otherwise(given), MARK))

    return bound(parts, lambda given: bound(form, lambda own: of(given, own)))


def variants(given: Column) -> Column:
    """A reviewer's variants, trimmed and without repeats, in order (FLT-10)."""
    return F.array_distinct(F.filter(F.transform(given, lambda x: F.btrim(F.regexp_replace(F.trim(x), SEPARATORS, MARK), F.lit(MARK))), lambda x: x != ""))


def language(label: Column) -> Column:
    """The language's full name; an unknown label is an error (FLT-11)."""
    known = F.lower(F.trim(label))
    out = F.when(label.isNull(), None)
    for short, name in LANGUAGES.items():
        out = out.when(known.isin(short, name), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown language: "), label)).cast("string"))
