"""Quality rules: a learned decision list over text statistics, as one Spark conditional expression.

Sequential covering on labelled statistics: numeric statistics of a bounded sample of labelled rows are cut at quantiles;
a rule grows one threshold condition at a time by information gain, is pruned from its end on rows it was not grown on,
and the rows it covers are set aside before the next rule. The list becomes CASE WHEN rule THEN false ... ELSE true.
Everything runs in DataFrame functions; the driver only holds the sample's counts.

Defined cases: a null text has no words (base_failed); rows with null doc_id are scored like others and never learned from;
labels other than 0 and 1 are not used; without labelled rows the list is empty and only the base decides; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import SPACES, packed

#: Labelled rows that a list is learned from (about; chosen by hash), cuts per statistic, conditions per rule, rules.
SAMPLE_ROWS, CUTS, CONDITIONS, RULES = 20_000, 24, 3, 12
#: What a rule must reach on the rows it is pruned on: share of rejected rows, and rows covered.
PRECISION, COVERED = 0.75, 5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_PLACE_BITS = 30


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated(h: Column) -> Column:
    """Words inside 3-word windows that occur at least twice; h: the words' hashes.

    Texts whose windows all differ, which most do, are told apart by counting distinct windows; only the others are sorted.
    """
    low = F.lit((1 << _PLACE_BITS) - 1).cast("long")
    head = lambda x: F.shiftright(x, _PLACE_BITS)
    beside = lambda s, same: F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))

    def counted(w: Column) -> Column:
        # part of the hash and the place in one number: sorting brings windows that may be equal together
        packed = F.sort_array(F.transform(w, lambda x, i: x.bitwiseAND(F.lit(-1 << _PLACE_BITS).cast("long")).bitwiseOR(i.cast("long"))))
        maybe = let(packed, lambda s: beside(s, lambda x, y: head(x) == head(y)))
        # then whole hashes decide
        full = F.array_sort(F.transform(maybe, lambda x: let(x.bitwiseAND(low).cast("int"), lambda i: F.struct(F.get(w, i).alias("w"), i.alias("i")))))
        sure = let(full, lambda s: beside(s, lambda x, y: x["w"] == y["w"]))
        at = F.sort_array(F.transform(sure, lambda x: x["i"]))
        gaps = let(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    windows = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    some = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(counted(w)))
    return F.when(F.size(h) >= 4, some).otherwise(0).cast("long")


def _counts(h: Column, x: Column, bare: Column, few: Column) -> Column:
    """The counts of a text from its words' hashes, its lines, its letters in words and those of them that are no small letters."""
    without = lambda chars: F.length(few) - F.length(F.translate(few, chars, ""))
    return F.struct(
        F.size(h).cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(h).alias("n_repeat_words"),
        F.size(F.array_distinct(h)).cast("long").alias("n_distinct_words"),
        F.size(x).cast("long").alias("n_lines"),
        without("0123456789").cast("long").alias("_digits"),
        without(".,;:!?").cast("long").alias("_stops"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("_capitals"),
    )


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """docs with the counts that the rules use; keep: columns that stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    trimmed = F.btrim(text, F.lit(SPACES))
    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    # what is counted are no small letters: without those, little is left to look through
    few = lambda b: F.translate(b, "abcdefghijklmnopqrstuvwxyz", "")
    hashes = F.transform(split, lambda w: F.xxhash64(w))
    found = let(hashes, lambda h: let(lines, lambda x: let(bare, lambda b: let(few(b), lambda c: _counts(h, x, b, c)))))
    # a generator: the optimiser copies none of its columns into later filters and projections
    rows = docs.select(*keep, F.inline(F.array(found)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


FEATURES = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _rate("word_chars", "n_words"),
    "symbols_per_word": lambda: _rate("n_symbols", "n_words"),
    "repeated_lines": lambda: _rate("n_dup_lines", "n_lines"),
    "repeated_words": lambda: _rate("n_repeat_words", "n_words"),
    "distinct_words": lambda: _rate("n_distinct_words", "n_words"),
    "words_per_line": lambda: _rate("n_words", "n_lines"),
    "digits": lambda: _rate("_digits", "word_chars"),
    "stops": lambda: _rate("_stops", "n_words"),
    "capitals": lambda: _rate("_capitals", "word_chars"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction; a row that one covers is rejected."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        out = None
        for rule in self.rules:
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join([f"reject if {' and '.join(map(str, r))}" for r in self.rules] + ["else keep"])


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def _count(cells, conditions) -> tuple[int, int]:
    """Rejected and clean rows that meet all conditions (feature number, above, cut number)."""
    hit = [0, 0]
    for (_, clean, bins), c in cells.items():
        if all((bins[f] > k) == above for f, above, k in conditions):
            hit[clean] += c
    return hit[0], hit[1]


def cover(cells: Counter, cuts: list[list[float]]) -> list[tuple]:
    """Sequential covering. cells: rows by (fold, clean, bins); fold 0 is pruned on, others are grown on."""
    grow, prune = ({k: c for k, c in cells.items() if (k[0] == 0) == side} for side in (False, True))
    rules = []
    while len(rules) < RULES:
        rule, left = [], grow
        while len(rule) < CONDITIONS:
            p0, n0 = _count(left, [])
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for f, own in enumerate(cuts):
                by_bin: dict[int, list[int]] = {}
                for (_, clean, bins), c in left.items():
                    by_bin.setdefault(bins[f], [0, 0])[clean] += c
                p = n = 0
                for k in range(len(own)):
                    a, b = by_bin.get(k, (0, 0))
                    p, n = p + a, n + b
                    best = max(best, (_gain(p, n, p0, n0), (f, False, k)), (_gain(p0 - p, n0 - n, p0, n0), (f, True, k)), key=lambda x: x[0])
            if best[1] is None:
                break
            rule.append(best[1])
            left = {k: c for k, c in left.items() if (k[2][best[1][0]] > best[1][2]) == best[1][1]}
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_count(prune, r))
        ends = [rule[:k] for k in range(1, len(rule) + 1)]
        if not ends:
            break
        rule = max(ends, key=worth)
        p, n = _count(prune, rule)
        if p + n < COVERED or p < PRECISION * (p + n):
            break
        rules.append(tuple(rule))
        grow, prune = ({k: c for k, c in side.items() if not all((k[2][f] > cut) == above for f, above, cut in rule)} for side in (grow, prune))
    return rules


def learn(docs: DataFrame, labels: DataFrame) -> DecisionList:
    """A decision list from docs(doc_id, text) and labels(doc_id, quality)."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    parts = max(1, round(usable.count() / SAMPLE_ROWS))
    chosen = lambda df: df.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(parts)) == 0)
    rows = statistics(chosen(docs.filter("doc_id is not null")), "doc_id").filter(~F.col("base_failed"))
    rows = rows.select("doc_id", *[f().alias(k) for k, f in FEATURES.items()])
    rows = rows.join(chosen(usable).select("doc_id", "quality"), "doc_id").persist()
    try:
        found = rows.agg(*[F.percentile_approx(k, [i / CUTS for i in range(1, CUTS)], 2000).alias(k) for k in FEATURES]).first()
        cuts = [sorted(set(found[k] or [])) for k in FEATURES]
        number = lambda k, own: F.size(F.filter(F.array(*map(F.lit, own)), lambda c: F.col(k) > c)) if own else F.lit(0)
        counted = rows.groupBy(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).alias("fold"), "quality", F.array(*[number(k, own) for k, own in zip(FEATURES, cuts, strict=True)]).alias("bins")).count()
        cells = Counter({(r["fold"], r["quality"], tuple(r["bins"])): r["count"] for r in counted.collect()})
    finally:
        rows.unpersist()
    names = list(FEATURES)
    return DecisionList(tuple(tuple(Condition(names[f], above, cuts[f][k]) for f, above, k in rule) for rule in cover(cells, cuts)))


def judge(docs: DataFrame, rules: DecisionList, *keep: str) -> DataFrame:
    """keep columns, the base counts, base_failed and kept."""
    rows = statistics(docs, *keep).withColumn("kept", ~F.col("base_failed") & rules.kept())
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, learned from those of docs that labels cover."""
    return judge(packed(docs, "text"), learn(docs, labels), "_row").filter("kept").select("_row.*")
