"""Operators that judge rows one by one: quality, HTML, language, toxicity, BPE."""

import hashlib
import random
from collections import Counter

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import WORD, words
from wordloom.llm import bpe, html_text, language_id, quality_rules, queries, toxicity
from wordloom.llm.pretokens import encode_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_quality_counts(spark, sf, odd):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), odd):
        rows = quality_rules.judge(docs, quality_rules.DecisionList(()), "text").collect()
        for r in rows:
            own = base(r["text"])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
            assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0]) and r.kept == (not r.base_failed)


def test_quality_learns_and_filters(spark, sf, odd, nothing, labels):
    found = queries.op1_quality_rules(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    passed = found[~found.base_failed]
    assert (passed.kept == (passed.quality == 1)).mean() > 0.95
    assert quality_rules.filter_quality(odd, labels).columns == odd.columns
    assert quality_rules.filter_quality(nothing, labels).count() == 0
    assert str(quality_rules.learn(nothing, labels)) == "else keep"


def test_cover_grows_and_prunes():
    cells = Counter()
    for fold in range(3):
        for a in range(4):
            for b in range(4):
                cells[(fold, int(not (a > 1 and b <= 1)), (a, b))] += 5
    rules = quality_rules.cover(cells, [[0.1, 0.2, 0.3]] * 2)
    hit = lambda bins: any(all((bins[f] > k) == above for f, above, k in r) for r in rules)
    assert all(hit((a, b)) == (a > 1 and b <= 1) for a in range(4) for b in range(4))


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>menu</a></nav>
<div class="cookie-notice"><p>We, use, cookies, and more of them.</p></div><div id=wrap><div class=sidebar><p>Side, bar, text.</p></div>
<div class="content"><h2>T&eacute;&nbsp;x</h2><p>One <b>two</b>three, four.<p>Five<br>six<ul><li>a<li>b</ul><script>if (a < b) {"</p>"}</script>
<div class="comments"><p>Nice, very, nice, article, indeed.</p></div></div></div><form>Name <input></form><footer>&copy; me</footer></body></html>"""


def test_html_parts_and_odd_pages(spark):
    assert html_text.main_text(PAGE) == "Té x One twothree, four. Five six a b"
    for page, text in ((None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>That it.</p>", "That it."), ("<article><p>Cut off <b", "Cut off"), ("<!-- x -->", ""), ("<nav>a</nav>", "")):
        assert html_text.main_text(page) == text
    long = "word, " * 50_000
    assert html_text.main_text(f"<main><p>{long}</p></main>") == long.strip()
    rows = [(1, "u", None, 1), (None, None, "<p>x</p>", 2), (1, "u", None, 1)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in out) == Counter([(1, "", 0), (None, "x", 1), (1, "", 0)])


def test_html_keeps_what_stands_beside():
    body = "".join(f"<p>Sentence {i}, with commas, and a good number of words in it to be scored.</p>" for i in range(12))
    text = " ".join(f"Sentence {i}, with commas, and a good number of words in it to be scored." for i in range(12))
    # a short closing paragraph beside the container, a headline and a byline above it
    assert html_text.main_text(f"<body><div><div>{body}</div><p>Short closing paragraph.</p></div></body>") == f"{text} Short closing paragraph."
    assert html_text.main_text(f"<article><h1>Head</h1><p>By me</p><div class=body>{body}</div></article>") == f"Head By me {text}"
    page = f"<body><nav><a href=x>menu</a></nav><div><a href=1>one</a> <a href=2>two</a></div><div id=c><h1>Head</h1>{body}</div><div class=sidebar>{body}</div><div><a href=1>link, link, link, link</a></div></body>"
    assert html_text.main_text(page) == f"Head {text}"
    assert html_text.main_text("<div>a</i></b></section>b</div>") == "ab" and html_text.main_text("<p title='a > b'>x</p><p title=\"y>z</p>") == "x z"
    assert html_text.main_text("a < b and 3<4, <5") == "a < b and 3<4, <5" and html_text.main_text("<p>x</p><!-- y") == "x"


def test_html_is_linear():
    import time

    begin = time.process_time()
    for unit in ('<a "', "<a ", "<div>x", "<p>", "<b>x</u>", "<li>a", '<a b="x>', "<h2>x", "<div></b>", "<a \"'", "<b>"):
        assert isinstance(html_text.main_text(unit * 100_000), str)
    html_text.main_text("<b>" * 200_000 + "</i>" * 200_000)
    html_text.main_text("<u><div>" + "<b>" * 100_000 + "</u>" * 100_000)
    assert time.process_time() - begin < 60


def test_html_finds_the_article(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op2_html_extraction(spark, sf).collect():
        body = re.search("<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        body = re.sub("<[^>]*>", "", re.sub("<br>|</?(p|h1)[^>]*>", " ", body))
        assert r.text == " ".join(html.unescape(body).split()) and r.n_chars == len(r.text)


def test_language_of_held_out_documents(spark, odd, nothing):
    d = "/root/testdata/sf0.01"
    found = queries.op3_language_id(spark, d).toPandas().merge(pd.read_parquet(f"{d}/documents.parquet"), on="doc_id")
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()
    model = language_id.learn(odd, MULTI)
    rows = language_id.predict(odd, model, "doc_id", "text").collect()
    assert {r.lang_pred for r in rows if r.text is None or r.text.strip() in ("", "***")} == {"und"}
    assert all(r.lang_pred == "de" for r in rows if r.doc_id == 6)
    empty = language_id.learn(nothing, MULTI)
    assert empty.languages == [] and {r.lang_pred for r in language_id.predict(odd, empty, "doc_id").collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = language_id.vocabulary(MULTI)
    n = sum(map(len, pieces))
    p = random.Random(1)
    probabilities = [p.random() / 50 for _ in range(n)] + [0.0]
    import numpy as np

    model = language_id.Model(["x"], pieces, np.array(probabilities)[:, None])
    value = {}
    for size, known in enumerate(pieces):
        value |= {(size, int(k)): probabilities[model.first[size] + i] for i, k in enumerate(known)}

    def of(piece):
        number = int.from_bytes(piece, "little")
        if len(piece) > 8:
            number = 0
            for byte in piece:
                number = (number * int(language_id._BASE) + byte + 1) % 2**64
        return value.get((len(piece), number), 0.0)

    def total(w):
        sums = [1.0] + [0.0] * len(w)
        for t in range(1, len(w) + 1):
            sums[t] = sum(sums[k] * of(w[k:t]) for k in range(t))
        return sums[-1]

    given = [b" the", b" international", b" x", "été".encode(), b" internationalisation", b" responsibilities" * 3]
    assert sum(len(k) for k in pieces[7:]) > 1000 and len(pieces[1]) == 256
    assert np.allclose(model.word_scores(given)[:, 0], [np.log(total(w)) for w in given])
    # expected counts weigh every segmentation by its share: their bytes add up to the word's
    for at, lattice in language_id.lattices(given, pieces, model.first):
        counts = lattice.expected(model.p, np.ones(len(at)), n)
        sizes = np.concatenate([[size] * len(k) for size, k in enumerate(pieces)])
        assert np.isclose((counts * sizes).sum(), sum(len(given[i]) for i in at))
    # words of any length: the log of the sum grows with the word, and counts are not lost
    long = [b" the" * 25, b" the" * 300]
    scores = model.word_scores(long)[:, 0]
    assert np.isfinite(scores).all() and scores[1] < scores[0] < 0
    for at, lattice in language_id.lattices(long, pieces, model.first):
        assert np.isclose((lattice.expected(model.p, np.ones(len(at)), n) * sizes).sum(), sum(len(long[i]) for i in at))


def test_toxicity(spark, odd, nothing, labels):
    d = "/root/testdata/sf0.01"
    found = queries.op4_toxicity(spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()
    clean = found[found.toxic == 0]
    assert clean.predicted.mean() < 0.03 and found[found.toxic == 1].predicted.mean() > 0.5
    grammar = toxicity.learn(odd, labels)
    rows = toxicity.score(odd, grammar, "doc_id", "text").collect()
    assert {r.score for r in rows if not r.text} == {grammar.scores[0]}
    assert toxicity.filter_toxic(odd, labels).columns == odd.columns and toxicity.filter_toxic(nothing, labels).count() == 0


def test_toxic_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot$": 3.0, "achlich": 2.0}, threats=frozenset(["stomp$"]))
    m = g.machine()
    plain, aimed, negated, told = (g.evidence(x, m) for x in ("an idiot here", "you are an idiot", "this is not an idiot", "he said an idiot"))
    assert aimed > plain > negated and told < aimed
    assert g.evidence("idiotic idiots", m) == 0 and g.evidence("Achlichung!", m) == 2.0
    assert g.evidence("kill", m) == 0 and g.evidence("you will be killed", m) == 0 and g.evidence("you kill", m) > 0
    assert all(g.evidence(x, m) > 0 for x in ("he kills you", "ich werde dich töten", "je vais te tuer", "te voy a matar", "stomp on you", "you stomp"))
    assert g.evidence("kill the process. you wait", m) == 0 and g.evidence("kill one two three four you", m) == 0 and g.evidence("stomp", m) == 0
    assert g.evidence(None, m) == 0 and g.evidence("x " * 100_000 + "idiot", m) == 3.0
    assert g.evidence("idiot. " * 3, m) == 9.0
    # a modifier counts from anywhere in its clause
    assert abs(g.evidence("you " + "word " * 500 + "idiot", m) - 3.7) < 1e-9 and g.evidence("you. " + "word " * 500 + "idiot", m) == 3.0


def test_composed_machine_equals_all_paths():
    """The composition against the transducers run one after another, over every path."""
    cascade = (toxicity._threats(), toxicity.transducer(0, (0,), [(0, "threat", "threat", toxicity.THREAT_WEIGHT, 0)]), toxicity._modified("target", toxicity.TARGET_WEIGHT), toxicity._negations(), toxicity._modified("report", toxicity.REPORTED_WEIGHT))
    g = toxicity.Grammar({"idiot$": 1.2, "scum$": 3.0})

    def paths(symbols, rest):
        """Every (weight, output) of the transducers in rest over the symbols."""
        if not rest:
            return [0.0]
        found = [(0.0, rest[0].start, [])]
        for x in symbols:
            found = [(w + v, then, [*out, y]) for w, state, out in found for y, v, then in rest[0].arcs[state][x]]
        return [w + v for w, _, out in found for v in paths(out, rest[1:])]

    def by_hand(clause):
        readings = [[]]
        for word in clause.split():
            readings = [[*r, x] for r in readings for x in g.readings(word)]
        return max(sum(w for _, w in r) + v for r in readings for v in paths([x for x, _ in r], cascade))

    r = random.Random(8)
    for _ in range(400):
        clause = " ".join(r.choice(["idiot", "scum", "kill", "you", "not", "said", "and", "so"]) for _ in range(r.randint(0, 7)))
        assert abs(g.walk(clause) - by_hand(clause)) < 1e-9, clause
    assert len(toxicity.MACHINE.arcs) > 20


def test_bpe_equals_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    r = random.Random(2)
    letters = "abs tredlm'' \n\t 　é5٣½!?\U0001f600'e\x1cćßǅ<|>"
    given = ["", "'s", " 's", "''s", "don't're'll", "a\n\nb", "  x", "x  ", "\n", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c", "<|endoftext", "x" * 5000, "ab" * 3000]
    given += ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    codec, ids = bpe.codec(PATH)
    found = [x.tolist() for x in encode_texts(pa.array([*given, None]), ids, codec.end_id)]
    assert found == [e.ids for e in tokenizer.encode_batch(given, add_special_tokens=False)] + [[]]
    import numpy as np

    for x in [*found[:-1], *([r.randrange(50257) for _ in range(20)] for _ in range(300))]:
        assert codec.decode(np.array(x, np.int64)) == tokenizer.decode(x, skip_special_tokens=False)


def test_bpe_of_long_words():
    import time

    tokenizer = Tokenizer.from_file(PATH)
    codec, ids = bpe.codec(PATH)
    r = random.Random(5)
    word = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    given = [word(bpe.LONG + k, letters) for k in (1, 2, 777) for letters in ("a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "éßæ")]
    given += [f"{word(3000, 'abc')} short {word(5000, 'xyz')}", "x" * 9001, "ab" * 4001 + "c"]
    assert [x.tolist() for x in encode_texts(pa.array(given), ids, codec.end_id)] == [e.ids for e in tokenizer.encode_batch(given, add_special_tokens=False)]
    long = word(400_000, "abcdefghijklmnopqrstuvwxyz")
    begin = time.process_time()
    found = codec.encode_words([long.encode(), b"ab"])
    assert time.process_time() - begin < 60
    assert found[0][: found[1][0]].tolist() == tokenizer.encode(long, add_special_tokens=False).ids and found[1][1] == len(tokenizer.encode("ab").ids)


def test_bpe_query_and_odd_rows(spark, sf, odd, nothing):
    tokenizer = Tokenizer.from_file(PATH)
    for docs in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), odd):
        want = Counter()
        for r in docs.collect():
            x = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
            digest = lambda raw: hashlib.sha256(raw).hexdigest()
            want[(r["doc_id"], len(x), digest(b"".join(i.to_bytes(4, "little") for i in x)), digest(tokenizer.decode(x, skip_special_tokens=False).encode()))] += 1
        assert Counter(tuple(r) for r in bpe.round_trip(docs, PATH).collect()) == want
    assert bpe.round_trip(nothing, PATH).count() == 0
    assert bpe.encode_frame(odd, PATH, "doc_id").filter(F.size("ids") == 0).count() == 3
