"""Review tables, changes, discovery and streams on small worlds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wordloom.operators import changes, discovery, review
from wordloom.sources import texts
from wordloom.streaming import events


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_inventory_and_aliases(spark):
    forms = frame(spark, "form string", ("maslo",), ("MASLO",), ("Aaah",), ("iPhone",), ("iphone",), ("okno",))
    marks = frame(spark, "form string, review_status string", ("okno", "invalid"), ("maslo", "verified"), ("MASLO", "human_review"))
    assert {r.form for r in texts.inventory(forms, marks).collect()} == {"maslo", "MASLO", "Aaah", "iPhone", "iphone"}
    named = review.representatives(forms)
    assert {tuple(r) for r in named.filter("form <> representative").collect()} == {("MASLO", "maslo"), ("iPhone", "iphone")}
    assert {r.representative: (r.form, r.review_status) for r in review.effective_adjudication(marks, named).collect()}["maslo"] == ("MASLO", "human_review")


def test_worklists(spark):
    upload = frame(spark, "position int, token string", (3, "Okno"), (1, "maslo"), (2, "x1"), (4, "maslo"), (5, "nové"))
    known = frame(spark, "form string", ("maslo",), ("okno",))
    assert {(r.token, r.position, r.form, r.status) for r in texts.worklist(upload, known).collect()} == {("Okno", 3, "okno", "known"), ("maslo", 1, "maslo", "known"), ("x1", 2, None, "rejected"), ("nové", 5, None, "addable")}
    assert [r.form for r in texts.append_unseen(known, upload).orderBy("form").collect()] == ["Okno", "nové"]


def test_prose_capitals(spark):
    docs = frame(spark, "doc_id int, text string", (1, "Mlyn stál. Videl Peter mlyn. Peter AHOJ spal"), (2, "# Názov\nPeter."))
    assert {r.doc_id: r.w for r in texts.prose_words(docs).orderBy("line", "sentence", "place").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "sentence", "place", "word"))), lambda x: x["word"]), " ").alias("w")).collect()} == {1: "mlyn stál videl Peter mlyn Peter ahoj spal", 2: "peter"}


def test_lines_cluster_from_their_first_word(spark):
    words = frame(spark, "page int, top double, left double, text string", (1, 10.0, 5.0, "b"), (1, 11.5, 1.0, "a"), (1, 12.5, 0.0, "c"), (1, 30.0, 0.0, "d"))
    assert [(r.line, r.text) for r in texts.line_clusters(words).orderBy("line").collect()] == [(0, "a b"), (1, "c"), (2, "d")]


def test_book_bodies(spark):
    good = "head\n*** START OF THE BOOK ***\nbody\n*** END OF THE BOOK ***\ntail"
    rows = frame(spark, "text string", (good,), (good + good,), ("none",)).select(texts.book_body(F.col("text"))).collect()
    assert [r[0] and r[0].strip() for r in rows] == ["body", None, None]


def test_projects(spark):
    a, b, c = frame(spark, "project_id int, name string", (1, "x"), (2, "y")), frame(spark, "chapter_id int, project_id int", (1, 1), (2, 2)), frame(spark, "chapter_id int, source_text string", (1, "t"), (2, "u"))
    assert [tuple(r) for r in texts.project_texts(a, b, c, ["x"]).collect()] == [("x", "t")]
    with pytest.raises(Exception, match="unknown project"):
        texts.project_texts(a, b, c, ["z"]).collect()


def test_undo(spark):
    ops = ["decide", "decide", "undo", "decide", "decide", "undo", "undo", "decide"]
    rows = frame(spark, "k int, seq int, operation string", *[(1, i, o) for i, o in enumerate(ops)], (2, 0, "undo"))
    assert {r.k: r.live for r in review.undo_state(rows, "k", "seq").collect()} == {1: [0, 7], 2: []}
    assert {r.k: r.target for r in review.undo_target(rows, "k", "seq").collect()} == {1: 7, 2: None}


def test_undo_stream_equals_the_batch(spark, tmp_path):
    ops = ["decide", "decide", "undo", "decide", "decide", "undo", "undo", "decide"]
    frame(spark, "key int, seq int, operation string", *[(1, i, o) for i, o in enumerate(ops)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key int, seq int, operation string").parquet(str(tmp_path / "in"))
    out = events.undo_stream(stream.select(F.col("key").cast("string").alias("key"), "seq", "operation"))
    q = out.writeStream.outputMode("update").format("memory").queryName("undo").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [tuple(r) for r in spark.sql("select * from undo").collect()] == [("1", 2)]


def test_unique_requests_and_leases(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    frame(spark, "ts timestamp, request_hash string", (t, "a"), (t, "b"), (t, "a")).write.parquet(str(tmp_path / "in"))
    q = events.unique_requests(spark.readStream.schema("ts timestamp, request_hash string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("unique_req").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.sql("select * from unique_req").count() == 2
    claims = frame(spark, "batch_id int, claim_token string, claimed_at timestamp", (1, "x", t), (2, "y", t - dt.timedelta(minutes=31)))
    assert [tuple(r) for r in events.leases(claims, t).collect()] == [(1, "x")]
    rows = frame(spark, "id int", (1,), (2,), (3,))
    assert [r.id for r in events.pending_rows(rows, frame(spark, "id int, status string", (1, "done"), (2, "error")), "id", 5).collect()] == [2, 3]


def test_verdicts(spark):
    verdicts = frame(spark, "run_id int, form string, status string", (1, "a", "x"), (2, "a", "y"), (1, "b", "z"))
    runs = frame(spark, "run_id int, rule_set_id int, prompt_id int, schema_id int, model_a_id int, model_b_id int, engine_version_id int, started_at string", (1, 1, 1, 1, 1, 2, 1, "2026-01"), (2, 2, 1, 1, 1, 2, 1, "2026-02"))
    rules = frame(spark, "rule_set_id int, version string", (1, "v1"), (2, "v2"))
    one = lambda k: frame(spark, f"{k} int, version string", (1, "p1"))
    models, engines = frame(spark, "model_id int, name string", (1, "m"), (2, "n")), frame(spark, "engine_version_id int, package_version string", (1, "0.1"))
    found = review.latest_verdicts(review.star(verdicts, runs, rules, one("prompt_id"), one("schema_id"), models, engines))
    assert {(r.form, r.status, r.is_latest_rules, r.is_latest_prompt) for r in found.collect()} == {("a", "y", True, True), ("b", "z", False, True)}
    queue = review.review_queue(frame(spark, "form string, action string, is_deleted int", ("A", "uncertain", None), ("c", "uncertain", 0), ("d", "uncertain", 1), ("e", "confirm", 0)), verdicts)
    assert [r.form for r in queue.collect()] == ["c"]


def test_consensus(spark):
    rows = [("a", 0, 1, "x", None), ("a", 0, 2, "x", None), ("b", 0, 1, "x", None), ("b", 0, 2, "y", None), ("b", 1, 2, "x", "accept"), ("c", 0, 1, "x", None), ("c", 0, 2, "y", None), ("c", 1, 1, "y", "uncertain"), ("d", 0, 1, "x", None), ("d", 0, 2, "y", None), ("e", 0, 1, "x", None)]
    found = review.consensus(frame(spark, "form string, turn int, model_id int, preferred string, vote string", *rows))
    assert {r.form: (r.status, r.preferred) for r in found.collect()} == {"a": ("agreed_independent", "x"), "b": ("agreed_after_review", "x"), "c": ("uncertain", None), "d": ("unresolved_disagreement", None), "e": ("invalid_response", None)}
    known = frame(spark, "sha256 string, version string", ("h", "1"))
    assert review.new_dimension_rows(known, frame(spark, "sha256 string, version string", ("h", "1"), ("g", "2"))).count() == 1
    with pytest.raises(Exception, match="another version"):
        review.new_dimension_rows(known, frame(spark, "sha256 string, version string", ("h", "2"))).collect()
    answers = frame(spark, "run_id int, form string, model_id int, stage string, preferred string, error string", (1, "a", 1, "independent", "x", None), (1, "a", 1, "review_2", "y", None), (1, "a", 1, "review_10", "z", "bad"))
    assert [r.preferred for r in review.final_proposals(answers).collect()] == ["y"] and review.answers_in_order(answers).first().stage == "independent"


def test_gate_fails_on_each_defect(spark):
    a, b = frame(spark, "w string, n int", ("x", 1), ("y", None), ("z", 3)), frame(spark, "w string, n int", ("x", 2), ("y", None), ("v", 3))
    found = changes.difference(a, b, "w")
    assert {(r.w, r.kind) for r in found.collect()} == {("x", "changed"), ("z", "removed"), ("v", "added")}
    allowed = found.select("w", "before", "after")
    problems = lambda x: {(r.w, r.problem) for r in changes.gate(found, x, "w").collect()}
    assert problems(allowed) == set()
    assert problems(allowed.filter("w <> 'x'")) == {("x", "unapproved")}
    assert problems(allowed.union(frame(spark, "w string, before string, after string", ("q", None, "1")))) == {("q", "stale")}
    assert problems(allowed.union(allowed.filter("w = 'x'"))) == {("x", "duplicate")}


def test_point_checks(spark):
    rows = frame(spark, "form string, before array<int>, after array<int>, remove array<int>, add array<int>", ("a", [1, 2], [2, 3], [1], [3]), ("b", [1], [1], [1], []))
    assert [r.form for r in changes.wrong_transitions(rows).collect()] == ["b"]
    points = frame(spark, "form string, points array<int>", ("abc", [1, 2]), ("abd", [3]), ("abe", [2, 1]), ("abf", []), ("abf", []))
    assert {tuple(r) for r in changes.invalid_points(points).collect()} == {("abd", "range"), ("abe", "order"), ("abf", "repeated")}
    a, b = frame(spark, "form string, language string, human string", ("x", "de", "de"), ("y", None, None), ("z", "fr", "en")), frame(spark, "form string, language string", ("x", None), ("y", "de"), ("z", "en"))
    assert tuple(changes.routing_changes(a, b).first()) == (1, 1, 1, 1)


def test_discovery(spark):
    inside = discovery.members_inside(frame(spark, "form string", ("priehrada",), ("hrad",), ("zahrada",)), frame(spark, "member string", ("hrad",)))
    assert {tuple(r) for r in inside.collect()} == {("priehrada", "hrad", 4), ("zahrada", "hrad", 2)}
    assert discovery.discovered(inside).first().score == 2.0
    div, spans = frame(spark, "word string, points array<int>", ("doktor", [2, 4])), frame(spark, "word string, role string, start int, end int", ("doktor", "root", 0, 4), ("doktor", "other", 4, 6))
    assert [tuple(r) for r in discovery.root_conflicts(div, spans).collect()] == [("doktor", 2, 0, 4)]
    entries, text = frame(spark, "entry_id int", (1,), (2,)), frame(spark, "entry_id int, position int, text string, role string", (1, 2, "or", "root"), (1, 1, "dokt", "root"), (1, 3, "x", "other"))
    assert {tuple(r) for r in discovery.spans_text(entries, text, "root").collect()} == {(1, "dokt or"), (2, None)}
    assert discovery.diverse_sample(["jahoda", "jahody", "strom", "okno"], 3, "s") == discovery.diverse_sample(["okno", "strom", "jahody", "jahoda"], 3, "s")
    picked = [f for f, tier in discovery.diverse_sample(["jahoda", "jahody", "strom", "okno"], 3, "s") if tier == 1]
    assert len(picked) == 3 and not {"jahoda", "jahody"} <= set(picked)
    items, answers = frame(spark, "position int, form string", (1, "a"), (2, "b")), frame(spark, "position int, form string", (1, "x"), (3, "c"))
    assert {tuple(r) for r in discovery.submission_problems(items, answers).collect()} == {(1, "other_form"), (2, "missing"), (3, "unexpected")}
    report = discovery.audit_report(frame(spark, "form string, assessment string, variants array<string>", ("a", "resolved", ["a"]), ("b", "resolved", ["c"]), ("d", "uncertain", [])), frame(spark, "form string, division string", ("a", "a"), ("b", "b"), ("d", "d")))
    assert {tuple(r) for r in report.collect()} == {("match", 1), ("mismatch", 1), ("unscored", 1)}
    row = frame(spark, "a string, b string", ("maslo", "masla")).select(discovery.jaccard(discovery.features(F.col("a")), discovery.features(F.col("b")))).first()
    pieces = [{f"^{w}$"[i : i + n] for n in (2, 3) for i in range(len(w) + 3 - n)} for w in ("maslo", "masla")]
    assert row[0] == len(pieces[0] & pieces[1]) / len(pieces[0] | pieces[1])


def test_folds_and_samples(spark):
    with pytest.raises(ValueError):
        review.page(frame(spark, "a int", (1,)), "a", limit=3000)
    rows = frame(spark, "form string, representative string, reviewed boolean, action string", ("a", "a", True, "confirm"), ("A", "a", True, "correct"), ("b", "b", False, None))
    assert tuple(review.statistics(rows).first()) == (2, 1, 1, 0)
    assert [r.w for r in texts.first_seen(frame(spark, "w string, n int", ("A", 2), ("a", 1)), F.lower("w"), "n").collect()] == ["a"]
    assert texts.exclusions(frame(spark, "form string", ("A",)), None, frame(spark, "form string", ("a",))).count() == 1


def test_request_cache_is_immutable(spark):
    empty = frame(spark, "request_hash string, request string, response string, state string")
    answer = "request string, response string, state string, seq int"
    one = review.cache_put(empty, frame(spark, answer, ("{1}", "b", "s", 2), ("{1}", "a", "s", 1)), "seq")
    two = review.cache_put(one, frame(spark, answer, ("{1}", "c", "t", 0), ("{2}", "d", "s", 3)), "seq")
    found = review.cached(frame(spark, "request string", ("{1}",), ("{2}",), ("{3}",)), two)
    assert {tuple(r) for r in found.collect()} == {("{1}", "a", "s"), ("{2}", "d", "s"), ("{3}", None, None)}
    bad = two.withColumn("request", F.lit("{9}"))
    with pytest.raises(Exception, match="cache request mismatch"):
        review.cached(frame(spark, "request string", ("{1}",)), bad).collect()
