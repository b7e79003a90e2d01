"""Work that must not grow with the tokens or with the square of a word: what a query reads, and words of many points."""

from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators import discovery, grammar
from wordloom.plans import more_queries  # noqa: F401  (registers its queries)
from wordloom.plans import queries as plans


def leaves(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def reads_documents(df) -> bool:
    return any("documents.parquet" in f for f in df.inputFiles())


def test_snapshot_problems_rest_on_saved_words(spark, sf):
    found = plans.QUERIES["snapshot_problems"](spark, sf)
    assert not reads_documents(found) and found.filter(F.col("problem") == "transition").count() > 0


def test_division_columns_are_computed_once(spark):
    """A word of 300 points: computed at every use, its offsets are of the fourth power."""
    form = "ba" * 300
    row = spark.createDataFrame([(form, list(range(2, 600, 2)))], "word string, p array<int>")
    w = F.col("word")
    out = row.select(X.offsets_of(X.hyphenate(w, F.col("p"))).alias("o"), X.recase(X.parts_of(w, F.col("p")), F.upper(w)).alias("r")).withColumn("plan", F.lit(0))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(p#") == 2  # the ends of the parts, once for each of the two columns
    found = out.first()
    assert found.o == list(range(2, 600, 2)) and found.r == "·".join(["BA"] * 300)
    odd = spark.createDataFrame([("", []), (None, [1]), ("žaba", [2]), ("a", None)], "word string, p array<int>")
    assert [tuple(r) for r in odd.select(X.hyphenate(w, F.col("p")), X.offsets_of(X.hyphenate(w, F.col("p"))), X.recase(X.parts_of(w, F.col("p")), F.upper(w))).collect()] == [("", [], ""), ("", [], ""), ("ža·ba", [2], "ŽA·BA"), (None, None, None)]


def test_conditions_on_types_are_not_pushed_to_tokens(spark, sf):
    plan = plans._types(spark, sf, "lang", least=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("Aggregate")  # the condition stands above the counts


def test_profile_evidence_rests_on_saved_types(spark, sf):
    assert not reads_documents(plans.QUERIES["profile_evidence"](spark, sf))


def test_router_weights_rest_on_saved_types(spark, sf):
    assert not reads_documents(plans.QUERIES["router_weights"](spark, sf))


def test_router_confusion_fits_its_weights_once(spark, sf):
    found = plans.QUERIES["router_confusion"](spark, sf)
    assert not reads_documents(found) and any("/weights-" in f for f in found.inputFiles())


def test_routing_difference_rests_on_saved_routes(spark, sf):
    assert not reads_documents(plans.QUERIES["routing_difference"](spark, sf))


def test_folded_search_reads_documents_once(spark, sf):
    assert leaves(plans.QUERIES["folded_search"](spark, sf)) == 1


def test_readings_are_made_without_sorts(spark):
    corpus = spark.createDataFrame([(f,) for f in ("žena", "ženy", "žene", "ženu", "dub", "duba", "dubu", None)], "form string")
    found = grammar.candidate_readings(corpus)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and ("žena", "žen", "žena", 3, "žien") in rows
    # one row for each form of a reading, whose own nominative is its lemma
    assert {r[4] for r in rows if r[:3] == ("dub", "dub", "dub")} == {"dub", "duba", "dubu", "dube", "dubom", "duby", "dubov", "duboch", "dubmi"}
    assert all((p, root, lemma, n, lemma) in rows for p, root, lemma, n, _ in rows)


def test_paradigm_cells_are_counted_in_parts_by_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(grammar, "TASK_ROWS", 50_000)
    found = plans.QUERIES["paradigm_cells"](spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not reads_documents(found) and "RepartitionByExpression [pattern" in plan and found.count() == 72


def test_substrings_that_are_no_members_are_ruled_out_before_the_join(spark):
    members = spark.createDataFrame([(f"m{i}é",) for i in range(500)] + [(None,), ("",)], "member string")
    others = spark.range(20_000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("w"))
    assert members.filter(discovery.may_hold(members, F.col("member"))).count() >= 501
    assert others.filter(discovery.may_hold(members, F.col("w"))).count() < 500  # about 500 of 262,144 bits are set
    forms = spark.createDataFrame([("ABab",), ("ab",), (None,), ("",), ("b",)], "form string")
    inside = discovery.members_inside(forms, forms.select(F.col("form").alias("member")), 1)
    assert {tuple(r) for r in inside.collect()} == {("ABab", "ab", 0), ("ABab", "ab", 2), ("ABab", "b", 1), ("ABab", "b", 3), ("ab", "b", 1)}
