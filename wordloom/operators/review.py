"""Review state as append-only tables: decisions, adjudications, verdicts (WN-*, REV-*, AI-*, FLT-3 .. FLT-5, SO-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of adjudication statuses, most binding first.
STATUSES = ("invalid", "human_review", "verified", "ai_agrees", "pending")
REVIEWED = ("expected_hyphenation", "hyphenation_action", "language", "is_foreign_word", "is_proper_name", "is_abbreviation", "corrected_form", "is_deleted")


def representatives(forms: DataFrame) -> DataFrame:
    """form, representative: a capitalised form stands under its lower-case twin where that exists (JN-7, DD-3)."""
    lower = forms.select(F.col("form").alias("twin"))
    rows = forms.select("form").join(lower, F.lower("form") == F.col("twin"), "left")
    return rows.select("form", F.coalesce("twin", "form").alias("representative"))


def aliases(named: DataFrame) -> DataFrame:
    """representative, aliases in order (JN-6)."""
    return named.groupBy("representative").agg(F.array_sort(F.collect_list("form")).alias("aliases"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key's last row by the given columns (WN-1, WN-3 .. WN-5); pre-aggregated, so a hot key is no sort."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return rows.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def effective_adjudication(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The binding adjudication of each representative: by status rank, its own form first, then by form (WN-2)."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("review_status"))
    rows = rows.join(named, "form").withColumn("_o", F.struct(F.when(rank == 0, len(STATUSES) + 1).otherwise(rank).alias("rank"), (F.col("form") != F.col("representative")).alias("alias"), F.col("form").alias("name")))
    return rows.groupBy("representative").agg(F.min_by(F.struct("form", "review_status"), "_o").alias("r")).select("representative", "r.*")


def is_reviewed(columns=REVIEWED) -> Column:
    """Any of the review columns is set; syllables do not count (FLT-4)."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNotNull()
    return out


def undo_state(events: DataFrame, key: str, order: str, operation: str = "operation") -> DataFrame:
    """key, live: events that stand after undo, oldest first (REV-4).

    Newest to oldest, an undo cancels the next decision that none has cancelled: a fold with one counter, over the events of
    one key (a store's log).
    """
    rows = events.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct(order, operation)))).alias("e"))
    kind = rows.schema["e"].dataType.elementType[order].dataType.simpleString()
    start = F.struct(F.lit(0).alias("k"), F.array().cast(f"array<{kind}>").alias("live"))

    def step(s: Column, e: Column) -> Column:
        undo = e[operation] == "undo"
        k = F.when(undo, s["k"] + 1).otherwise(F.greatest(s["k"] - 1, F.lit(0)))
        return F.struct(k.alias("k"), F.when(~undo & (s["k"] == 0), F.concat(F.array(e[order]), s["live"])).otherwise(s["live"]).alias("live"))

    return rows.select(key, F.aggregate("e", start, step)["live"].alias("live"))


def undo_target(events: DataFrame, key: str, order: str) -> DataFrame:
    """key, target: the decision the next undo would cancel."""
    return undo_state(events, key, order).select(key, F.element_at(F.when(F.size("live") > 0, F.col("live")), -1).alias("target"))


def star(verdicts: DataFrame, runs: DataFrame, rules: DataFrame, prompts: DataFrame, schemas: DataFrame, models: DataFrame, engines: DataFrame) -> DataFrame:
    """Verdicts with the labels of their run's dimensions (JN-2)."""
    model = lambda side: models.select(F.col("model_id").alias(f"model_{side}_id"), F.col("name").alias(f"model_{side}"))
    out = verdicts.join(runs, "run_id")
    out = out.join(rules.select("rule_set_id", F.col("version").alias("rules")), "rule_set_id").join(prompts.select("prompt_id", F.col("version").alias("prompt")), "prompt_id")
    out = out.join(schemas.select("schema_id", F.col("version").alias("schema")), "schema_id").join(model("a"), "model_a_id").join(model("b"), "model_b_id")
    return out.join(engines.select("engine_version_id", "package_version"), "engine_version_id")


def latest_verdicts(joined: DataFrame) -> DataFrame:
    """Each form's newest verdict, and whether it used the newest rules and prompt (WN-3)."""
    newest = joined.agg(F.max("rules").alias("_rules"), F.max("prompt").alias("_prompt"))
    rows = latest(joined, "form", "started_at", "run_id").crossJoin(F.broadcast(newest))  # one row
    return rows.withColumn("is_latest_rules", F.col("rules") == F.col("_rules")).withColumn("is_latest_prompt", F.col("prompt") == F.col("_prompt")).drop("_rules", "_prompt")


def final_proposals(answers: DataFrame) -> DataFrame:
    """Each model's last valid proposal by turn (WN-5)."""
    turn = F.coalesce(F.regexp_extract("stage", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    rows = answers.filter("error is null and preferred is not null").withColumn("turn", turn)
    return rows.groupBy("run_id", "form", "model_id").agg(F.max_by("preferred", F.struct("turn", "preferred")).alias("preferred"))


def answers_in_order(answers: DataFrame) -> DataFrame:
    """Independent answers first, then by turn (AI-8)."""
    return answers.orderBy("run_id", "form", (F.col("stage") != "independent").cast("int"), "stage", "model_id")


def consensus(answers: DataFrame, most_turns: int = 4) -> DataFrame:
    """form, status, preferred, from recorded answers(form, turn, model_id, preferred, vote) (AI-2).

    Turn 0 holds two independent proposals; later turns review the other's last proposal until one accepts it exactly.
    """
    bad = F.max(F.col("preferred").isNull()).alias("bad")
    first = answers.filter("turn = 0").groupBy("form").agg(F.count_distinct("preferred").alias("kinds"), F.min("preferred").alias("same"), F.count("*").alias("n"), bad)
    review = answers.filter(f"turn between 1 and {most_turns}").groupBy("form").agg(F.min(F.when(F.col("vote") == "accept", F.struct("turn", "preferred"))).alias("accepted"), F.min(F.when(F.col("vote") == "uncertain", F.col("turn"))).alias("uncertain"))
    rows = first.join(review, "form", "left")
    at = F.col("accepted.turn")
    status = (
        F.when(F.col("bad") | (F.col("n") != 2), "invalid_response")
        .when(F.col("kinds") == 1, "agreed_independent")
        .when(at.isNotNull() & (F.col("uncertain").isNull() | (at < F.col("uncertain"))), "agreed_after_review")
        .when(F.col("uncertain").isNotNull(), "uncertain")
        .otherwise("unresolved_disagreement")
    )
    rows = rows.withColumn("status", status)
    return rows.select("form", "status", F.when(F.col("status") == "agreed_independent", F.col("same")).when(F.col("status") == "agreed_after_review", F.col("accepted.preferred")).alias("preferred"))


def review_queue(decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Uncertain, live decisions without a verdict yet (AI-7, JN-5)."""
    open_ = decisions.filter((F.col("action") == "uncertain") & (F.coalesce("is_deleted", F.lit(0)) == 0))
    judged = verdicts.select(F.lower("form").alias("_f")).distinct()
    return open_.join(judged, F.lower("form") == F.col("_f"), "left_anti").select("form")


def new_dimension_rows(known: DataFrame, given: DataFrame) -> DataFrame:
    """Rows of given(sha256, version) to append; the same text under another version is an error (AI-6)."""
    clash = given.join(known.select("sha256", F.col("version").alias("_v")), "sha256", "left")
    ok = F.when(F.col("_v").isNotNull() & (F.col("_v") != F.col("version")), F.raise_error(F.lit("same text under another version")).cast("boolean")).otherwise(F.col("_v").isNull())
    return clash.filter(ok).select(*given.columns)


def page(rows: DataFrame, *order: str, offset: int = 0, limit: int = 2000) -> DataFrame:
    """A page in a total order with the total (SO-2)."""
    if limit > 2000:
        raise ValueError("a page holds 2000 rows at most")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def hash_sample(rows: DataFrame, k: int, seed: str, *parts: str) -> DataFrame:
    """The k rows with the smallest sha256 of seed and parts (SO-4)."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), *parts), 256), *parts).limit(k)


def reconcile(manual: DataFrame, blind: DataFrame, engine: DataFrame) -> DataFrame:
    """form, bucket of three voices (REV-8, JN-9); each has form and a division."""
    rows = manual.select("form", F.col("division").alias("m")).join(blind.select("form", F.col("division").alias("b")), "form", "full").join(engine.select("form", F.col("division").alias("e")), "form", "left")
    m, b, e = F.col("m"), F.col("b"), F.col("e")
    bucket = (
        F.when(m.isNull(), F.when(b == e, "blind_engine").otherwise("blind_only"))
        .when(b.isNull(), F.when(m == e, "manual_engine").otherwise("manual_only"))
        .when((m == b) & (b == e), "all_agree")
        .when(m == b, "engine_differs")
        .when(m == e, "blind_differs")
        .when(b == e, "manual_differs")
        .otherwise("all_differ")
    )
    return rows.select("form", bucket.alias("bucket"))


def statistics(items: DataFrame) -> DataFrame:
    """Counts over representatives (AG-8)."""
    own = items.filter(F.col("form") == F.col("representative"))
    return own.agg(F.count("*").alias("forms"), F.count_if("reviewed").alias("reviewed"), F.count_if(F.col("reviewed") & (F.col("action") == "confirm")).alias("confirmed"), F.count_if(F.col("reviewed") & (F.col("action") == "correct")).alias("corrected"))


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests(request) with response, state of cache(request_hash, request, response, state), null where it holds none (AI-4).

    Requests are canonical JSON; a hash that stands for another request is an error.
    """
    held = cache.select("request_hash", F.col("request").alias("_held"), "response", "state")
    rows = requests.join(held, F.sha2("request", 256) == F.col("request_hash"), "left")
    checked = lambda c: F.when(F.col("_held") == F.col("request"), F.col(c)).when(F.col("_held").isNotNull(), F.raise_error(F.lit("cache request mismatch")))
    return rows.select(*[F.col(c) for c in requests.columns], checked("response").alias("response"), checked("state").alias("state"))


def cache_put(cache: DataFrame, answers: DataFrame, order: str) -> DataFrame:
    """cache with answers(request, response, state, order) added; what it holds stays, and the first answer of a request counts (AI-4)."""
    new = answers.withColumn("request_hash", F.sha2("request", 256)).join(cache.select("request_hash"), "request_hash", "left_anti")
    row = F.struct("request", "response", "state")
    first = new.groupBy("request_hash").agg(F.min_by(row, order).alias("r"))
    return cache.select("request_hash", "request", "response", "state").union(first.select("request_hash", "r.*"))
