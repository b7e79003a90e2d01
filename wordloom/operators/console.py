"""The joined review view, its filters, decisions and exports (FLT-3, FLT-5, FLT-7, REV-1, REV-3, REV-5 .. REV-7, SNK-3, SNK-6, AG-14, AUD-4, AUD-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators import review

FLAGS = {"foreign": "is_foreign_word", "proper": "is_proper_name", "abbreviation": "is_abbreviation", "deleted": "is_deleted", "corrected_form": "corrected_form"}
ROW_ACTIONS, OUTPUT_ACTIONS = ("flag", "invalid", "classify"), ("confirm", "correct", "uncertain")


def items(forms: DataFrame, decisions: DataFrame, adjudications: DataFrame, verdicts: DataFrame, engine: DataFrame) -> DataFrame:
    """One wide row a representative: newest decision, binding adjudication, newest verdict, engine output (REV-5)."""
    named = review.representatives(forms)
    state = review.latest(decisions.join(named, "form").drop("form"), "representative", "decision_seq", "decided_at")
    binding = review.effective_adjudication(adjudications, named).drop("form")
    newest = review.latest(verdicts.join(named, "form").drop("form"), "representative", "started_at", "run_id").select("representative", F.col("preferred").alias("verdict"))
    out = named.filter("form = representative").select("representative").join(state, "representative", "left").join(binding, "representative", "left").join(newest, "representative", "left")
    return out.join(engine.select(F.col("form").alias("representative"), F.col("division").alias("engine"), F.col("error").alias("engine_error")), "representative", "left")


def has_status(status: str) -> Column:
    """The condition of a status filter over items() (FLT-3)."""
    decided = F.col("decision_seq").isNotNull()
    reviewed = review.is_reviewed([c for c in review.REVIEWED])
    other = lambda a, b: F.col(a).isNotNull() & (F.lower(a) != F.lower(b))
    known = {
        "": F.lit(True), "all": F.lit(True), "undecided": ~decided | ~reviewed, "incomplete": ~decided | ~reviewed, "mine": decided & reviewed,
        "ai_verdict": F.col("verdict").isNotNull(), "ai_verdict_differs": other("verdict", "engine"), "engine_disagree": other("expected_hyphenation", "engine"),
        "engine_error": F.col("engine_error").isNotNull(),
    }
    known |= {k: F.col(c).isNotNull() & ~F.col(c).cast("string").isin("0", "", "false") for k, c in FLAGS.items()}
    known |= {a: F.col("row_action") == a for a in ROW_ACTIONS} | {a: F.col("hyphenation_action") == a for a in OUTPUT_ACTIONS}
    if status.startswith("profile_"):
        return F.col("profile") == status.removeprefix("profile_")
    return known.get(status, F.col("review_status") == status)


def first_mode(expected: Column, preferred: Column, permissive: Column, contextual: Column, both: Column) -> Column:
    """The first output mode that gives the expected division (FLT-7)."""
    return F.when(expected == preferred, "preferred").when(expected == permissive, "permissive").when(expected == contextual, "contextual").when(expected == both, "both")


def decide(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events to append and rejected ones with their reason, each judged on its own (REV-1, REV-2)."""
    division = X.parse_marked(F.col("form"), F.col("typed"))
    reason = (
        F.when(F.col("form").isNull() | (F.col("form") == ""), "no form")
        .when(~F.col("action").isin(*ROW_ACTIONS, *OUTPUT_ACTIONS), "unknown action")
        .when((F.col("action") == "correct") & F.col("typed").isNull(), "a correction needs a division")
        .when(F.col("typed").isNotNull() & division.isNull(), "the letters differ from the form")
    )
    rows = events.withColumn("expected_hyphenation", division).withColumn("problem", reason)
    return rows.filter("problem is null").drop("problem"), rows.filter("problem is not null")


def cleared(decisions: DataFrame, named: DataFrame, representative: str) -> DataFrame:
    """The events that clear an alias group; syllable verdicts stay (REV-3)."""
    group = named.filter(F.col("representative") == representative).select("form")
    own = decisions.join(group, "form", "left_semi")
    keep = {"form", "expected_syllabification", "syllabification_action"}
    return own.select(*[F.col(c) if c in keep else F.lit(None).cast(t).alias(c) for c, t in own.dtypes])


def with_proposals(view: DataFrame, evidence: DataFrame) -> DataFrame:
    """A foreign inventory's view: stored proposals stand for the engine (REV-6)."""
    stored = evidence.select(F.col("form").alias("representative"), F.col("proposed_hyphenation").alias("_p"))
    return view.join(stored, "representative", "left").withColumn("engine", F.coalesce("_p", "engine")).drop("_p")


def blind_verdicts(files: DataFrame) -> DataFrame:
    """form, variants of verdict lines(file_ord, line): a later file wins (REV-7)."""
    rows = files.select("file_ord", F.from_json("line", "form string, variants array<string>").alias("v")).select("file_ord", "v.*").filter("form is not null")
    return review.latest(rows, "form", "file_ord").select("form", "variants")


def corrections(view: DataFrame) -> DataFrame:
    """JSON lines of decided divisions that still differ from the engine (SNK-6)."""
    rows = view.filter(F.col("expected_hyphenation").isNotNull() & ~F.col("expected_hyphenation").eqNullSafe(F.col("engine")))
    return rows.select(F.to_json(F.struct(F.col("representative").alias("form"), F.col("expected_hyphenation").alias("expected"), "engine")).alias("value"))


def write_report(rows: DataFrame, path: str) -> None:
    """A TSV report with a header; an existing one is an error (SNK-3)."""
    rows.write.mode("errorifexists").option("sep", "\t").option("header", True).csv(path)


def family_report(occurrences: DataFrame) -> DataFrame:
    """member, family, counters by status, contexts and sorted occurrences of (member, family, form, status) (AG-14)."""
    left = F.split_part("form", F.col("member"), F.lit(1))
    return occurrences.groupBy("member", "family").agg(
        F.count("*").alias("forms"),
        F.count_if(F.col("status") == "verified").alias("verified"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_distinct(left).alias("contexts"),
        F.array_sort(F.collect_set("form")).alias("occurrences"),
    )


def integrity_problems(items_: DataFrame, decisions: DataFrame, log: DataFrame, batches: DataFrame) -> DataFrame:
    """problem, n over an audit run: batch hashes, membership, log against decisions (AUD-4); empty means intact."""
    lines = items_.withColumn("line", F.concat_ws("\t", "batch_id", "position", "form", "selection_tier"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"])
    hashes = lines.groupBy("batch_id").agg(F.sha2(F.concat(F.array_join(ordered, "\n"), F.lit("\n")), 256).alias("h"), F.count("*").alias("k"))
    wrong = batches.join(hashes, "batch_id", "left").filter(~F.col("h").eqNullSafe(F.col("batch_sha256")) | (F.col("k") != F.col("item_count")))
    keys = ["batch_id", "position", "form"]
    foreign = decisions.join(items_, keys, "left_anti")
    last = log.groupBy("batch_id", "position").agg(F.max_by("form", "seq").alias("form"))
    unlogged = decisions.join(last, keys, "left_anti").select("batch_id").union(last.join(decisions, keys, "left_anti").select("batch_id"))
    count = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    return count(wrong, "batch hash").union(count(foreign, "not in the batch")).union(count(unlogged, "log differs")).filter("n > 0")


def dictionary_entries(lines: DataFrame, code: str = r"^[A-Z]\d*[a-z]?$") -> DataFrame:
    """Entry columns of lines(text): origin, motivation, analysis, code, parse_status (AUD-10).

    An entry opens with digits joined by commas and one of M, N, P; its code is the first later token that looks like one.
    """
    t = F.split(F.trim("text"), r"\s+")
    at = F.aggregate(F.sequence(F.lit(3), F.greatest(F.size(t) - 1, F.lit(3))), F.lit(-1), lambda a, i: F.when((a < 0) & F.coalesce(F.get(t, i).rlike(code), F.lit(False)), i).otherwise(a))
    opens = (F.size(t) >= 3) & F.get(t, F.lit(0)).rlike(r"^\d(?:,\d)*\*?$") & F.get(t, F.lit(1)).isin("M", "N", "P")
    rows = lines.withColumn("_t", t).withColumn("_at", at).withColumn("_e", opens)
    analysis = F.array_join(F.when(F.col("_at") < 0, F.slice("_t", 3, F.size("_t"))).otherwise(F.slice("_t", 3, F.greatest(F.col("_at") - 2, F.lit(0)))), " ")
    only = lambda c: F.when(F.col("_e"), c)
    return rows.select(
        "text",
        only(F.get("_t", F.lit(0))).alias("origin"),
        only(F.get("_t", F.lit(1))).alias("motivation"),
        only(analysis).alias("analysis"),
        only(F.when(F.col("_at") >= 0, F.get("_t", F.col("_at")))).alias("code"),
        F.when(~F.col("_e"), "not_entry").when(F.col("_at") < 0, "partial").otherwise("parsed").alias("parse_status"),
    )
