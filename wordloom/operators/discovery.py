"""Members, families, diverse samples, root conflicts, dictionary lookups (AUD-*, JN-10, JN-11, JN-14 .. JN-16)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import saved


def features(form: Column) -> Column:
    """Distinct two- and three-letter pieces of ^form$ (AUD-2)."""
    text = F.concat(F.lit("^"), F.lower(form), F.lit("$"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.concat(of(2), of(3)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(both / F.size(F.array_union(a, b)))


#: Bits for each member in the table that rules out other strings, and the largest table (32 MB).
BITS, MOST_BITS = 16, 1 << 28


def may_hold(members: DataFrame, value: Column) -> Column:
    """False only where members(member) surely lacks a value: one bit for each member's hash, as 64-bit words in chunks of 4096."""
    size = min(MOST_BITS, 1 << max(18, (BITS * members.count()).bit_length()))
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(size - 1))
    by = lambda f, c, n: F.call_function(f, c, n.cast("int") if isinstance(n, Column) else F.lit(n))
    bit = lambda h: h.bitwiseAND(F.lit(63))
    h = F.col("h")
    words = members.select(place(F.col("member")).alias("h")).groupBy(by("shiftright", h, 6).alias("id")).agg(F.bit_or(by("shiftleft", F.lit(1).cast("long"), bit(h))).alias("w"))
    every = members.sparkSession.range(size >> 6).join(words, "id", "left").select("id", F.coalesce("w", F.lit(0).cast("long")).alias("w"))
    chunks = every.groupBy(by("shiftright", F.col("id"), 12).alias("k")).agg(F.array_sort(F.collect_list(F.struct("id", "w")))["w"].alias("ws"))
    table = chunks.agg(F.array_sort(F.collect_list(F.struct("k", "ws")))["ws"].alias("t")).scalar()
    at = place(value)
    word = F.get(F.get(table, by("shiftright", at, 18)), by("shiftright", at, 6).bitwiseAND(F.lit(4095)))
    return by("shiftright", word, bit(at)).bitwiseAND(F.lit(1)) == 1


def members_inside(forms: DataFrame, members: DataFrame, shortest: int = 3) -> DataFrame:
    """form, member, at: dictionary members inside forms, by an equality join on their substrings (JN-10).

    Most substrings are no members: a table of bits rules them out before they are sent to the join, which decides.
    """
    members = saved(members.select("member").filter("member is not null").distinct(), "members")
    sizes = members.filter(F.length("member") >= shortest).groupBy(F.left("member", F.lit(1)).alias("initial")).agg(F.collect_set(F.length("member")).alias("sizes"))
    text = F.col("text")
    rows = forms.select("form", F.lower("form").alias("text"))
    rows = rows.select("form", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("form") - shortest, F.lit(0)))).alias("at"))
    rows = rows.withColumn("initial", F.substring(text, F.col("at") + 1, F.lit(1))).join(sizes, "initial")  # only lengths that a member of this initial has
    fits = (F.col("n") <= F.length(text) - F.col("at")) & (F.col("n") < F.length("form"))
    cut = rows.select("form", "text", "at", F.explode("sizes").alias("n")).filter(fits).select("form", "at", F.substring(text, F.col("at") + 1, F.col("n")).alias("member"))
    return cut.filter(may_hold(members, F.col("member"))).join(members, "member").select("form", "member", "at")


def discovered(inside: DataFrame, most_examples: int = 5) -> DataFrame:
    """member, forms, contexts, score, examples: ranked by the harmonic mean of forms and left contexts (AUD-8, AG-11, AG-12)."""
    left = F.substring("form", F.lit(1), F.col("at"))
    out = inside.groupBy("member").agg(F.count_distinct("form").alias("forms"), F.count_distinct(left).alias("contexts"), F.slice(F.array_sort(F.collect_set("form")), 1, most_examples).alias("examples"))
    return out.withColumn("score", 2 * F.col("forms") * F.col("contexts") / (F.col("forms") + F.col("contexts")))


def root_conflicts(divisions: DataFrame, spans: DataFrame) -> DataFrame:
    """word, seam, start, end: division points strictly inside a dictionary root (AUD-9, JN-11)."""
    seams = divisions.select("word", F.explode("points").alias("seam"))
    found = seams.join(spans.filter("role = 'root'"), "word").filter((F.col("seam") > F.col("start")) & (F.col("seam") < F.col("end")))
    return found.select("word", "seam", "start", "end")


def spans_text(entries: DataFrame, spans: DataFrame, role: str) -> DataFrame:
    """Entries with their spans of a role in order (JN-15)."""
    text = spans.filter(F.col("role") == role).groupBy("entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("spans"))
    return entries.join(text, "entry_id", "left")


def affix_lookup(words: DataFrame, affixes: Iterable[str], suffix: bool = False) -> DataFrame:
    """word, affix: listed prefixes (or suffixes) of words, one equality test for each distinct length (JN-14)."""
    by_size: dict[int, list[str]] = {}
    for a in affixes:
        by_size.setdefault(len(a), []).append(a)
    cut = lambda n: F.right("word", F.lit(n)) if suffix else F.left("word", F.lit(n))
    hits = F.array_compact(F.array(*[F.when((F.length("word") > n) & cut(n).isin(*found), cut(n)) for n, found in sorted(by_size.items())]))
    return words.select("word", F.explode(hits).alias("affix"))


def phrase_matches(docs: DataFrame, phrase: list[str]) -> DataFrame:
    """doc_id, at of an exact phrase over a tokenised inverted table(doc_id, position, token) (JN-16)."""
    rows = docs.filter(F.col("token").isin(*phrase))
    hits = rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(phrase)])).alias("p"), "position", "token")
    hits = hits.filter("p.t = token").select("doc_id", (F.col("position") - F.col("p.i")).alias("at"), F.col("p.i").alias("i"))
    return hits.groupBy("doc_id", "at").agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(phrase)).select("doc_id", "at")


#: Similarity limits of the tiers of a diverse sample, and how often a prefix or suffix may recur in each.
TIERS = ((0.34, 1), (0.44, 2), (0.56, 4), (1.01, 1_000_000))


def diverse_sample(forms: list[str], count: int, seed: str) -> list[tuple[str, int]]:
    """(form, tier): greedy, each pick depends on all before, so one ordered pass over a bounded list (AUD-1)."""
    import hashlib

    order = sorted(set(forms), key=lambda f: hashlib.sha256(f"{seed}:{f}".encode()).hexdigest())
    pieces = {f: {f"^{f}$"[i : i + n] for n in (2, 3) for i in range(len(f) + 3 - n)} for f in order}
    index: dict[str, list[int]] = {}
    taken: list[tuple[str, int]] = []
    used: set[str] = set()
    ends: dict[tuple[str, str], int] = {}
    for tier, (limit, most) in enumerate(TIERS, 1):
        for form in order:
            if len(taken) == count:
                return taken
            if form in used or ends.get(("<", form[:3]), 0) >= most or ends.get((">", form[-3:]), 0) >= most:
                continue
            shared: dict[int, int] = {}
            for p in pieces[form]:
                for k in index.get(p, ()):
                    shared[k] = shared.get(k, 0) + 1
            if any(n / (len(pieces[form]) + len(pieces[taken[k][0]]) - n) >= limit for k, n in shared.items()):
                continue
            for p in pieces[form]:
                index.setdefault(p, []).append(len(taken))
            taken.append((form, tier))
            used.add(form)
            for end in (("<", form[:3]), (">", form[-3:])):
                ends[end] = ends.get(end, 0) + 1
    return taken


#: Ranges that batches() numbers on their own.
RANGES = 64


def batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """batch_id and position of rows in a total order (WN-8): numbers inside ranges, after the counts of the ranges before."""
    key = F.struct(*order)
    # bounds are the keys of least hash, so every evaluation finds the same ones
    some = rows.select(key.alias("_key")).distinct().orderBy(F.xxhash64("_key"), "_key").limit(RANGES - 1)
    bounds = some.agg(F.collect_list("_key").alias("_bounds"))
    cut = rows.join(F.broadcast(bounds), how="cross").withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= key))).drop("_bounds")  # one row
    counts = cut.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_count"))
    ahead = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("_r", F.coalesce(F.sum("_count").over(ahead), F.lit(0)).alias("_ahead"))  # at most RANGES rows
    n = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_ahead")
    numbered = cut.join(F.broadcast(ahead), F.col("_range") == F.col("_r")).withColumn("_n", n)
    return numbered.withColumn("batch_id", F.floor(F.col("_n") / size) + 1).withColumn("position", F.col("_n") % size + 1).drop("_n", "_range", "_r", "_ahead")


def contiguous_block(rows: DataFrame, size: int, seed: str, *order: str) -> DataFrame:
    """size neighbouring rows in a total order, from a place that a seed chooses (WN-7); all rows if they are fewer."""
    numbered = batches(rows, 1, *order).withColumn("_n", F.col("batch_id") - 1).drop("batch_id", "position")
    n = rows.count()
    first = F.pmod(F.xxhash64(F.lit(seed)), F.lit(max(1, n - size + 1)))
    return numbered.filter((F.col("_n") >= first) & (F.col("_n") < first + size)).drop("_n")


def lexicon_evidence(tables: dict[str, DataFrame | None]) -> DataFrame:
    """word, lemma, source of whichever lexicon tables there are, each row once; a missing column is null (FLT-13)."""
    kept = []
    for name, t in tables.items():
        if t is not None:
            column = lambda c, t=t: (F.col(c) if c in t.columns else F.lit(None)).cast("string").alias(c)
            kept.append(t.select(column("word"), column("lemma"), F.lit(name).alias("source")))
    out = kept[0]
    for t in kept[1:]:
        out = out.unionByName(t)
    return out.filter("word is not null").dropDuplicates()


def role_lookup(entries: DataFrame, variants: DataFrame, spans: DataFrame, surface: str, role: str) -> tuple[DataFrame, DataFrame]:
    """Entries with a variant of a surface form, and entries with a span of it in a role, with their variants if any (JN-3)."""
    exact = entries.join(variants.filter(F.col("surface") == surface), "entry_id").select("entry_id", "raw_text", "notation").distinct()
    found = spans.filter((F.col("role") == role) & (F.col("surface") == surface)).select("entry_id").distinct()
    return exact, found.join(entries.select("entry_id", "raw_text"), "entry_id", "left").join(variants.select("entry_id", "notation"), "entry_id", "left").distinct()


def submission_problems(items: DataFrame, answers: DataFrame) -> DataFrame:
    """position, problem of a batch's answers: missing, unexpected, another form (AUD-6, AI-1); empty means complete."""
    rows = items.select("position", F.col("form").alias("a")).join(answers.select("position", F.col("form").alias("b")), "position", "full")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "other_form")
    return rows.select("position", problem.alias("problem")).filter("problem is not null")


def audit_report(decisions: DataFrame, engine: DataFrame) -> DataFrame:
    """outcome, n: whether the engine's division is among a reviewer's variants (AUD-7)."""
    rows = decisions.join(engine, "form", "left")
    outcome = F.when(F.col("assessment") != "resolved", "unscored").when(F.array_contains("variants", F.col("division")), "match").otherwise("mismatch")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
