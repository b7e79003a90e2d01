"""Foreign adaptation and the review console's view, filters and exports."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wordloom.functions import prosody
from wordloom.operators import console, foreign, review


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def adapted(spark, *rows):
    """The adapted division of each (word, language, raw points, seams)."""
    df = frame(spark, "word string, language string, raw array<int>, seams array<int>", *[(*r, []) if len(r) == 3 else r for r in rows])
    return [r.v for r in df.select(foreign.adapt(*map(F.col, df.columns)).alias("v")).collect()]


def test_adapting_points(spark):
    given = [
        (("katzen", "german", [3]), [2]), (("atzen", "german", [2]), []), (("fenster", "german", [4]), [3]), (("fenster", "german", [4], [4]), [4]),
        (("citron", "french", [2]), [3]), (("théâtre", "french", []), [3]), (("poésie", "french", [3]), [2, 3]), (("secrète", "french", [2]), [3]),
        (("reprendre", "french", [2]), [2]), (("afrique", "french", []), [2]), (("âpre", "french", []), []), (("sitzende", "german", [3, 6]), [2, 6]),
        (("Fensterbank", "german", [4, 7]), [3, 7]), (("entziehen", "german", [3, 6]), [3, 6]), (("achromatique", "french", [1, 5]), [3, 5]), ((None, "german", []), []),
    ]
    found = adapted(spark, *[x for x, _ in given])
    assert [r.points for r in found] == [p for _, p in given] and all(r.error is None for r in found)
    assert [tuple(c) for c in found[0].changes] == [(3, 2, "de_tz_single_affricate")] and [tuple(c) for c in found[1].changes] == [(2, None, "de_tz_single_affricate")]
    assert [tuple(c) for c in found[5].changes] == [(None, 3, "fr_hiatus")] and found[0].native == [3]
    bad = adapted(spark, ("x", "dutch", []), ("a1", "german", []), ("abc", "german", [], [3]), ("abcd", "german", [], [2]))
    assert [r.error for r in bad] == ["BAD_LANGUAGE", "UNSUPPORTED_SPELLING", "BAD_MORPHEME_POINT", None]
    assert [tuple(c) for c in bad[3].changes] == [(None, 2, "verified_morpheme")]


def test_inflected_and_described(spark):
    df = frame(spark, "stem string, ending string, p array<int>", ("stein", "ovi", []), ("hering", "om", [2]), ("berlin", "ska", [3]), ("strauß", "e", []), ("schuh", "a", []))
    assert [r[0] for r in df.select(foreign.inflected_german(*map(F.col, df.columns))).collect()] == [[4, 6], [2, 6], [3, 6], [5], []]
    wood = [[("w", "v"), ("oo", "u"), ("d", "d")]]
    two = [[("w", "v"), ("oo", "u"), ("d", "d")], [("s", "s"), ("t", "t"), ("o", "o"), ("ck", "k")]]
    rows = [("woodovi", wood, "ovi"), ("woodska", wood, "ska"), ("wood", wood, ""), ("woodstockom", two, "om"), ("ada", [[("a", "a"), ("d", "d"), ("a", "a")]], "")]
    df = frame(spark, "word string, parts array<array<struct<spelling:string,role:string>>>, ending string", *rows)
    found = [(r.v.points, r.v.contextual) for r in df.select(foreign.described_points(*map(F.col, df.columns)).alias("v")).collect()]
    assert found == [([3, 5], []), ([4], []), ([], []), ([4, 7], []), ([], [1])]


def test_written_points_of_columns(spark):
    words = ["mama", "sestra", "matka", "vlk", "vrstva", "jablko", "lživý", "lhota", "vŕba", "kaviareň", "prst", "mliečny", "obrstva", "trojuholník", "a", "x"]
    found = frame(spark, "w string", *[(w,) for w in words]).select("w", prosody.written_points(F.col("w")).alias("p")).collect()
    assert {r.w: r.p for r in found} == {w: prosody.written_breaks(w) for w in words}


def test_routing(spark):
    candidates = frame(spark, "word string, language string, stem string, ending string", ("a", "de", "a", ""), ("b", "de", "b", ""), ("c", "fr", "c", ""))
    evidence = frame(spark, "word string, language string, stem string, ending string, flagged boolean", ("a", "de", "a", "", True), ("b", "de", "b", "", True), ("b", "fr", "b", "", True), ("c", "fr", "x", "", True))
    assert [r.word for r in foreign.routed(candidates, evidence).collect()] == ["a"]
    m = foreign.routing_metrics(frame(spark, "language string, routed string", ("de", "de"), ("de", "fr"), ("de", None))).first()
    assert (m.words, m.right, m.wrong, m.unrouted, m.accuracy) == (3, 1, 1, 1, 0.5)
    rows = frame(spark, "word string, raw array<int>", ("katzen", [3]), ("haus", [])).select(F.lit("german").alias("language"), foreign.adapt(F.col("word"), F.lit("german"), F.col("raw")).alias("v"))
    s = foreign.adapter_statistics(rows).first()
    assert (s.types, s.changed_words, s.added_points, s.removed_points) == (2, 1, 1, 1) and foreign.rule_histogram(rows).count() == 1


def test_evidence_tables(spark):
    rows = frame(spark, "form string, phones string, complete boolean, error string, points array<int>", ("a", None, None, None, []), ("b", "x", False, None, [1]), ("c", "x", True, None, [1]), ("d", None, None, "bad", []))
    assert [(r.pronunciation_status, r.proposal_status) for r in foreign.evidence_row(rows).orderBy("form").collect()] == [("pending", "pending"), ("generated", "incomplete"), ("generated", "candidate"), ("error", "error")]
    stored = frame(spark, "form string, proposed_hyphenation string, pronunciation_status string, phones string, error string", ("ab", "a·b", "generated", "x", None), ("cd", "c·x", "generated", None, None), ("cd", None, "pending", None, None))
    assert {tuple(r) for r in foreign.inventory_problems(stored).collect()} == {("cd", "repeated"), ("cd", "letters"), ("cd", "status")}
    plan = foreign.reprojection_plan(frame(spark, "form string, division string, reviewed boolean", ("a", "x", False), ("b", "x", True), ("c", "x", None)), frame(spark, "form string, division string", ("a", "y"), ("b", "y"), ("c", "x")))
    assert [tuple(r) for r in plan.collect()] == [("a", "x", "y")]


DECISION = "form string, decision_seq int, decided_at string, row_action string, hyphenation_action string, expected_hyphenation string, language string, is_foreign_word int, is_proper_name int, is_abbreviation int, corrected_form string, is_deleted int"


def test_view_and_filters(spark):
    forms = frame(spark, "form string", ("mlyn",), ("Mlyn",), ("okno",), ("auto",))
    decisions = frame(spark, DECISION, ("mlyn", 1, "t1", None, "confirm", "mlyn", None, 0, 0, 0, None, 0), ("Mlyn", 2, "t2", None, "correct", "m·lyn", None, 1, 0, 0, None, 0))
    adjudications = frame(spark, "form string, review_status string", ("okno", "verified"))
    verdicts = frame(spark, "form string, started_at string, run_id int, preferred string", ("okno", "t", 1, "ok·no"))
    engine = frame(spark, "form string, division string, error string", ("mlyn", "mlyn", None), ("okno", "o·kno", None), ("auto", None, "bad"))
    view = console.items(forms, decisions, adjudications, verdicts, engine)
    chosen = lambda s: {r.representative for r in view.filter(console.has_status(s)).collect()}
    assert chosen("all") == {"mlyn", "okno", "auto"} and chosen("correct") == {"mlyn"} and chosen("confirm") == set()
    assert chosen("undecided") == {"okno", "auto"} and chosen("mine") == {"mlyn"} and chosen("foreign") == {"mlyn"} and chosen("proper") == set()
    assert chosen("ai_verdict") == {"okno"} == chosen("ai_verdict_differs") == chosen("verified") and chosen("engine_disagree") == {"mlyn"} and chosen("engine_error") == {"auto"}
    assert [r.value for r in console.corrections(view).collect()] == ['{"form":"mlyn","expected":"m·lyn","engine":"mlyn"}']
    stored = frame(spark, "form string, proposed_hyphenation string", ("auto", "au·to"))
    assert {r.representative: r.engine for r in console.with_proposals(view, stored).collect()}["auto"] == "au·to"
    emptied = console.cleared(decisions, review.representatives(forms), "mlyn")
    assert emptied.count() == 2 and emptied.filter("expected_hyphenation is not null").count() == 0


def test_decisions(spark):
    events = frame(spark, "form string, action string, typed string", ("okno", "correct", "ok-no"), ("okno", "correct", None), ("okno", "dance", None), ("okno", "correct", "ok-na"), (None, "confirm", None))
    good, bad = console.decide(events)
    assert [r.expected_hyphenation for r in good.collect()] == ["ok·no"] and bad.count() == 4
    mode = frame(spark, "e string", ("a",), ("c",), ("x",)).select(console.first_mode(F.col("e"), F.lit("a"), F.lit("a"), F.lit("c"), F.lit("d"))).collect()
    assert [r[0] for r in mode] == ["preferred", "contextual", None]


def test_audit_integrity(spark):
    lines = "1\t1\ta\t1\n1\t2\tb\t1\n"
    items = frame(spark, "batch_id int, position int, form string, selection_tier int", (1, 1, "a", 1), (1, 2, "b", 1))
    batches = lambda h: frame(spark, "batch_id int, batch_sha256 string, item_count int", (1, h, 2))
    good = hashlib.sha256(lines.encode()).hexdigest()
    decisions = frame(spark, "batch_id int, position int, form string", (1, 1, "a"))
    log = frame(spark, "batch_id int, position int, form string, seq int", (1, 1, "x", 1), (1, 1, "a", 2))
    problems = lambda *a: {r.problem for r in console.integrity_problems(*a).collect()}
    assert problems(items, decisions, log, batches(good)) == set()
    assert problems(items, decisions, log, batches("0")) == {"batch hash"}
    assert problems(items, decisions, log.filter("seq = 1"), batches(good)) == {"log differs"}
    assert problems(items, frame(spark, "batch_id int, position int, form string", (1, 1, "z")), log, batches(good)) == {"not in the batch", "log differs"}


def test_dictionary_and_reports(spark, tmp_path):
    rows = console.dictionary_entries(frame(spark, "text string", ("1,2 M dokt-or-ø S1 more",), ("1 N slovo bez",), ("text",))).collect()
    assert [(r.parse_status, r.analysis, r.code) for r in rows] == [("parsed", "dokt-or-ø", "S1"), ("partial", "slovo bez", None), ("not_entry", None, None)]
    out = console.family_report(frame(spark, "member string, family string, form string, status string", ("hrad", "h", "zahrada", "verified"), ("hrad", "h", "priehrada", "pending"))).first()
    assert (out.forms, out.verified, out.pending, out.contexts, out.occurrences) == (2, 1, 1, 2, ["priehrada", "zahrada"])
    blind = frame(spark, "file_ord int, line string", (1, '{"form":"a","variants":["x"]}'), (2, '{"form":"a","variants":["y"]}'), (3, "no"))
    assert [tuple(r) for r in console.blind_verdicts(blind).collect()] == [("a", ["y"])]
    console.write_report(blind, str(tmp_path / "r"))
    with pytest.raises(Exception, match="exist"):
        console.write_report(blind, str(tmp_path / "r"))
