"""Functions on words and divisions, against examples and plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from wordloom.functions import phonology as P
from wordloom.functions import prosody
from wordloom.functions import text as X
from wordloom.operators import alignment, grammar, liang, ngrams
from wordloom.sources import tex


def values(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "word, expected",
    [("mama", "ma·ma"), ("sestra", "ses·tra"), ("matka", "mat·ka"), ("vlk", "vlk"), ("vrstva", "vrst·va"), ("jablko", "ja·bl·ko"), ("Anna", "An·na"), ("dieťa", "die·ťa"), ("mucha", "mu·cha"), ("medza", "me·dza"), ("", None), ("x1", None)],
)
def test_syllables(word, expected):
    found, error = prosody.syllables(word)
    assert ("·".join(found) if found else None) == expected
    assert (error is None) == (expected is not None)


@pytest.mark.parametrize("word, expected", [("rvať", "rvať"), ("Rmútiť", "Rmú·tiť"), ("rdieť", "rdieť"), ("lstivý", "lsti·vý"), ("lživý", "lži·vý"), ("lhať", "lhať"), ("ľnie", "ľnie"), ("lnie", "lnie"), ("ržať", "r·žať")])
def test_initial_r_and_l_without_syllable(word, expected):
    assert "·".join(prosody.syllables(word)[0]) == expected


def test_reviewed_language(spark):
    words = spark.createDataFrame([("Boucherova\u0301",), ("boucher",), ("bouchers",), ("a‐b",), (None,)], "word string")
    labels = spark.createDataFrame([("boucherová", "french"), ("boucher", "french"), ("a-b", "english")], "form string, language string")
    found = {r.word: r.language for r in ngrams.reviewed_language(words, labels).collect()}
    assert found == {"Boucherova\u0301": "french", "boucher": "french", "bouchers": None, "a‐b": "english", None: None}


def test_division_levels():
    assert prosody.division("matka") == ([3], [], [], None)
    assert prosody.division("mesto") == ([3], [], [], None)
    assert prosody.division("oko") == ([], [], [1], None)
    assert prosody.division("radio") == ([2], [], [], None)
    assert prosody.division("rozbiť", [3]) == ([3], [], [], None)
    assert prosody.division("ping-pong") == ([5], [], [], None)
    assert prosody.division("a1")[3] == "UNSUPPORTED_SPELLING" and prosody.division(None) == ([], [], [], None)
    assert prosody.division("queen") == ([], [], [], None)


def test_nuclei_agree_with_columns(spark):
    words = ["vlk", "prst", "kŕmiť", "anna", "mierl", "rl", "dieťa", "chlieb", "stĺp", "ôsmy", ""]
    for w, n in values(spark, [(w,) for w in words], "w string", "w", P.nuclei(P.phonemes(F.col("w")))):
        assert n == prosody.layout(w).nuclei and "".join(prosody.layout(w).sounds) == w


def test_viterbi():
    counts = {"pre": 10, "pis": 5, "ok": 3}
    total = sum(counts.values())
    cost = {m: math.log(total / n) for m, n in counts.items()}
    assert prosody.viterbi("prepisok", cost, total) == ["pre", "pis", "ok"] and prosody.viterbi("", cost, total) == []


def test_text_columns(spark):
    word = F.col("w")
    assert values(spark, [("Straße É",)], "w string", X.folded(word)) == [("strasse e",)]
    given = [("Côtes-du-Rhône",), ("-a",), ("a" * 61,), ("d'Art",), ("1",), ("",)]
    assert [r[0] for r in values(spark, given, "w string", X.is_addable(word))] == [True, False, False, True, False, False]
    typed = [("matka", " mat--ka "), ("matka", "ma·tko"), ("matka", None)]
    assert [r[0] for r in values(spark, typed, "w string, t string", X.parse_marked(word, F.col("t")))] == ["mat·ka", None, None]
    assert values(spark, [("a·bc·d",)], "w string", X.offsets_of(word)) == [([1, 3],)]
    assert values(spark, [("Matka", [3])], "w string, p array<int>", X.hyphenate(word, F.col("p")), X.divisions(word, F.col("p"))) == [("Mat·ka", ["Mat-ka"])]
    assert values(spark, [("Matka", [])], "w string, p array<int>", X.hyphenate(word, F.col("p"))) == [("Matka",)]
    assert values(spark, [(["mat", "ka"], "MATka"), (["mat"], "MATka")], "p array<string>, w string", X.recase(F.col("p"), word)) == [("MAT·ka",), ("mat",)]
    assert values(spark, [("Jeden. Dva tri!",), ("a b\nc d",), ("# a, b.",)], "w string", X.looks_like_prose(word)) == [(True,), (False,), (False,)]
    assert values(spark, [([" a-b ", "a·b", ""],)], "v array<string>", X.variants(F.col("v"))) == [(["a·b"],)]
    assert values(spark, [("DE ",), (None,)], "w string", X.language(word)) == [("german",), (None,)]
    with pytest.raises(Exception, match="unknown language"):
        values(spark, [("xx",)], "w string", X.language(word))
    with pytest.raises(ValueError):
        X.within(word, word, 0)


def test_sound_columns(spark):
    w = F.col("w")
    assert values(spark, [("b",), ("Š",), ("a",)], "w string", P.voice_pair(w)) == [("p",), ("ž",), (None,)]
    assert values(spark, [("mám",)], "w string", P.shorten(w), P.lengthen(w), P.is_long_syllable(w)) == [("mam", "mám", True)]
    pairs = [("v", "vozík"), ("s", "ženou"), ("k", "mame"), ("vo", "vode"), ("k", "")]
    assert [r[0] for r in values(spark, pairs, "w string, n string", P.preposition_fits(w, F.col("n")))] == [False, False, True, True, True]
    assert [r[0] for r in values(spark, [("vlk",), ("bcd",), ("kŕm",), ("most",), ("prst",)], "w string", P.ends_with_two_consonants(P.phonemes(w)))] == [False, True, False, True, True]
    assert [r[0] for r in values(spark, [("vstrčme",), ("bcdfgha",), ("bc",), ("漢",)], "w string", P.is_plausible(w))] == [True, False, False, False]


def liang_by_hand(word, patterns, left, right):
    padded, votes = f".{word}.", [0] * (len(word) + 4)
    for i in range(len(padded)):
        for frag, off, digit in patterns:
            if padded.startswith(frag, i):
                votes[i + off] = max(votes[i + off], digit)
    return [p for p in range(1, len(word)) if votes[p + 1] % 2 and left <= p <= len(word) - right]


def test_liang(spark):
    weights = tex.pattern_weights(["1ba", "a1b2c", ".x3y", "c4d", "longerpattern1s", "1cd", "d1."])
    words = ["ababcd", "xyxy", "longerpatterns", "a", "abcd", "cdcdcd"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    found = dict(map(tuple, liang.break_points(frame, spark.createDataFrame(weights, tex.WEIGHTS), 1, 1).collect()))
    assert found == {w: liang_by_hand(w, weights, 1, 1) for w in words}
    exceptions = spark.createDataFrame([("xyxy", [1, 2, 3])], "word string, points array<int>")
    found = dict(map(tuple, liang.break_points(frame, spark.createDataFrame(weights, tex.WEIGHTS), 2, 2, exceptions).collect()))
    assert found["xyxy"] == [2]


def test_tex_files(spark, tmp_path):
    (tmp_path / "p.tex").write_text("% c\n\\patterns{ a1b % x\n .c2d\na2b }\n\\hyphenation{ ta-ble pro-ject-s }\n", encoding="utf-8")
    weights, exceptions = tex.read_tex(spark, str(tmp_path / "p.tex"))
    assert {tuple(r) for r in weights.collect()} == {("ab", 1, 2), (".cd", 2, 2)}
    assert {(r.word, tuple(r.points)) for r in exceptions.collect()} == {("table", (2,)), ("projects", (3, 7))}
    assert [r.pattern for r in tex.tex_lines(weights).collect()] == [".c2d", "a2b"]
    tex.write_tex(weights, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        tex.write_tex(weights, str(tmp_path / "out"))


def test_agreement_of_nothing_is_one(spark):
    rows = spark.createDataFrame([("a", [], []), ("b", [], [])], "word string, e array<int>, x array<int>")
    r = liang.agreement(rows, "e", "x").first()
    assert (r.words, r.exact, r.precision, r.recall, r.f_beta) == (2, 1, 1, 1, 1)


def test_numbers_and_learning(spark):
    words = {r.number: r.word for r in liang.cardinals(spark).collect()}
    assert [words[n] for n in (1, 10, 12, 21, 99, 100, 101, 212, 1000)] == ["jeden", "desať", "dvanásť", "dvadsaťjeden", "deväťdesiatdeväť", "sto", "stojeden", "dvestodvanásť", "tisíc"]
    assert len(set(words.values())) == 1000
    targets = spark.createDataFrame([(w, prosody.division(w)[0]) for w in list(words.values())[:60]], "word string, points array<int>")
    learned = liang.learn(targets)
    found = liang.break_points(targets, learned, 1, 1).join(targets.withColumnRenamed("points", "want"), "word")
    r = liang.agreement(found, "want", "points").first()
    assert r.precision > 0.9 and r.recall > 0.8
    assert liang.exceptions(found, "want", "points").count() < 30


def test_alternations(spark):
    given = {
        ("žen", "≤"): "žien", ("noh", "≤"): "nôh", ("srdc", "≤"): "sŕdc", ("svet", "x"): "svet", ("stôl", "≥"): "stol", ("viet", "≥"): "vet", ("práv", "≥"): "prav", ("otec", "»«"): "otc", ("pies", "»«"): "ps",
        ("deň", "»«"): "dň", ("ab", "»«"): "ab", ("kráľ", "*"): "král", ("Čech", "*"): "Češ", ("krásk", "«o»"): "krások", ("oko", "«o»"): "oko", ("dievč", "+at"): "dievčat", ("génius", "-us"): "géni", ("géni", "-us"): "géni",
        ("Turek", "k/c"): "Turec", ("Turek", "g/c"): "Turek", ("Turek", "ek/"): "Tur",
    }
    found = values(spark, list(given), "root string, code string", "root", "code", grammar.alternated(F.col("root"), F.col("code")))
    assert {(r, c): x for r, c, x in found} == given
    cells = grammar.codes_of_cells(("+ať+2367sg", "+at", "pl"))
    assert cells[1] == ["+ať"] and cells[6] == ["+at"] and cells[0] == [] and grammar.codes_of_cells(("≤", "+2pl", "*"))[7] == ["≤", "*"]
    assert [x for x, in values(spark, [("oblasťi hosťia ňe",)], "w string", grammar.without_soft_mark(F.col("w")))] == ["oblasti hostia ňe"]
    roots = spark.createDataFrame([("žen", "žena"), ("x", "none"), (None, "žena")], "root string, pattern string")
    forms = [r.form for r in grammar.paradigms(roots).orderBy(F.desc("number"), F.array_position(F.array(*map(F.lit, grammar.CASES)), F.col("case"))).collect()]
    assert forms == ["žena", "ženy", "žene", "ženu", "žene", "ženou", "ženy", "žien", "ženám", "ženy", "ženách", "ženami"]
    own = grammar.pattern_table(spark, {"hrdina": ("a|u|ovi|u|ovi|om|ovia|ov|om|ov|och|ami", ())})
    assert {r.form for r in grammar.paradigms(spark.createDataFrame([("hrdin", "hrdina")], "root string, pattern string"), own).collect()} >= {"hrdina", "hrdinovia", "hrdinami"}


def test_induction(spark):
    forms = ["žena", "ženy", "žene", "ženu", "žien", "dub", "duba", "dubu", "kameň"]
    found = {(r.pattern, r.lemma): (r.support, r.owned) for r in grammar.induced(spark.createDataFrame([(f,) for f in forms], "form string")).collect()}
    assert found[("žena", "žena")] == (4, 5) and ("dub", "dub") in found | {("chlap", "dub"): 0, ("dub", "dub"): 0}


def spans_of(*given):
    return [(s, p.split()) for s, p in given]


@pytest.mark.parametrize(
    "word, spans, expected",
    [
        ("pepper", [("pe", "pʰ ɛ"), ("pp", "p"), ("er", "ɚ")], "pep·per"), ("bunny", [("bu", "b ʌ"), ("nn", "ɲ"), ("y", "i")], "bun·ny"), ("abbey", [("a", "æ"), ("bb", "bʲ"), ("ey", "i")], "ab·bey"),
        ("peggy", [("pe", "pʰ"), ("g", "ɛ"), ("g", "ɟ"), ("y", "i")], "peg·gy"), ("digging", [("di", "d"), ("g", "ɪ"), ("gi", "ɟ ɪ"), ("ng", "ŋ")], "dig·ging"), ("people", [("pe", "pʰ iː"), ("op", "p"), ("le", "ə ɫ")], "peo·ple"),
        ("rocking", [("ro", "ɹ ɑ"), ("ck", "c"), ("i", "ɪ"), ("ng", "ŋ")], "ro·cking"), ("bottled", [("bo", "b ɑ"), ("tt", "t"), ("le", "ə ɫ"), ("d", "d")], "bo·ttled"), ("add", [("a", "æ"), ("dd", "d")], "add"),
        ("about", [("a", "ə"), ("b", "b"), ("ou", "aw"), ("t", "t")], "about"), ("rhythm", [("rh", "ɹ"), ("y", "ɪ"), ("th", "ð"), ("m", "m̩")], None),
    ],
)
def test_projection(word, spans, expected):
    points, complete = alignment.projected(word, spans_of(*spans))
    again = alignment.repaired(spans_of(*spans))
    assert "".join(s for s, _ in again) == word and [x for _, p in again for x in p] == [x for _, p in spans for x in p.split()]
    assert complete == (expected is not None)
    if expected:
        cuts = [0, *points, len(word)]
        assert "·".join(word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)) == expected


def test_alignment(spark):
    percussion = spans_of(("p", "pʰ"), ("er", "ɚ"), ("cu", "kʰ"), ("s", "ɐ"), ("si", "ʃ"), ("on", "ə n"))
    assert not alignment.projected("percussion", percussion)[1] and alignment.projected("other", percussion) == ([], False)
    assert alignment.projected("penny", spans_of(("pe", "p ɛ"), ("nn", "n"), ("y", "i")), "german") == ([2], True)
    pepper = spans_of(("pe", "p ɛ"), ("pp", "p"), ("er", "ɚ"))
    schema = "word string, spans array<struct<spelling:string,phones:array<string>>>, phones string, score double"
    df = spark.createDataFrame([("pepper", pepper, "p ɛ p ɚ", 1.0), ("pep", pepper, "p ɛ p ɚ", 1.0), ("pepper", pepper, "p ɛ p ɚ", float("nan"))], schema)
    assert [r[0] for r in df.select(alignment.is_valid(*map(F.col, df.columns))).collect()] == [True, False, False]
    told = {
        "modest": spans_of(("mo", "m ɑː"), ("de", "d ə"), ("st", "s t")), "modestly": spans_of(("mo", "m ɑː"), ("de", "d ə"), ("st", "s t"), ("ly", "ʎ i")), "pen": spans_of(("pe", "pʰ ɛ"), ("n", "n")),
        "knife": spans_of(("kn", "n"), ("i", "aj"), ("f", "f"), ("e", "")), "penknife": spans_of(("pe", "pʰ ɛ"), ("n", "n"), ("kn", ""), ("i", "aj"), ("f", "f"), ("e", "")), "car": spans_of(("car", "k ɑ ɹ")),
        "pet": spans_of(("pet", "p ɪ t")), "carpet": spans_of(("car", "k ɑ ɹ"), ("pet", "p ɪ t")), "cold": spans_of(("cold", "k ow l d")), "coldness": spans_of(("cold", "k ow l d"), ("ness", "n ə s")),
        "coldly": spans_of(("cold", "k ow l d"), ("ly", "l i")), "gently": spans_of(("gent", "dʒ ɛ n t"), ("ly", "l i")), "percussion": percussion,
    }
    lexicon = spark.createDataFrame([(w, x, " ".join(p for _, ps in x for p in ps)) for w, x in told.items()], "word string, spans array<struct<spelling:string,phones:array<string>>>, phones string")
    words = lexicon.select("word", F.split("phones", " ").alias("phones"))
    assert {tuple(r) for r in alignment.seams(words, words).collect()} == {("modestly", 6), ("penknife", 3), ("coldly", 4)}
    asked = spark.createDataFrame([(w,) for w in ("Penknife", "modestly", "percussion", "unknown", "caf\u00e9", "pen")], "word string")
    found = {r.word: r.points for r in alignment.english_points(asked, lexicon).collect()}
    assert found == {"Penknife": [3], "modestly": [2, 6], "percussion": None, "unknown": None, "caf\u00e9": None, "pen": []}
    assert {r.word: r.points for r in alignment.english_points(asked, lexicon, asked.filter("word = 'pen'")).collect()}["modestly"] is None


def test_keyed_paradigms(spark):
    roots = spark.createDataFrame([("pekn", "pekný"), (None, "pekný"), ("x", "none")], "root string, pattern string")
    forms = {r.key: r.form for r in grammar.keyed_paradigms(roots, grammar.adjective_table(spark)).collect()}
    assert len(forms) == 36 and forms["m.anim.sg.nom"] == "pekný" and forms["f.sg.ins"] == "peknou" and forms["m.anim.pl.nom"] == "pekní"
    soft = grammar.keyed_paradigms(roots.limit(1), grammar.adjective_table(spark), softens=True).filter("key = 'm.anim.sg.nom' or key = 'm.anim.pl.nom'").collect()
    assert {r.form for r in soft} == {"pekňý", "pekní"}
    verbs = grammar.keyed_paradigms(spark.createDataFrame([("vol", "volať")], "root string, pattern string"), grammar.verb_table(spark))
    assert {r.form for r in verbs.collect()} >= {"volať", "volám", "volajú", "volala"}
    active = grammar.participles(verbs.filter("key = 'pres.3pl'"), "c", "pekný", grammar.adjective_table(spark))
    assert "volajúcou" in {r.form for r in active.collect()}
    table = spark.createDataFrame([("ten", "toho"), ("ten", "tej"), ("oba", "oboch")], "lemma string, form string")
    assert {tuple(r) for r in grammar.closed_class(spark.createDataFrame([("toho",), ("oboch",), ("dom",)], "word string"), table).collect()} == {("toho", "ten"), ("oboch", "oba")}


def test_qu_and_outputs(spark):
    assert prosody.syllables("qualita")[0] == ["qua", "li", "ta"] and prosody.syllables("Quido")[0] == ["Qui", "do"]
    df = spark.createDataFrame([("qualita",), ("mama",), ("oko",)], "word string")
    out = {r.word: r for r in prosody.public_output(df).collect()}
    assert out["mama"].preferred == [2] and out["mama"].syllables == "ma·ma" and out["oko"].contextual == [1] and out["oko"].preferred == []
    pairs = spark.createDataFrame([("krás", "ny"), ("krás", "ný"), ("pek", "ný"), ("", "")], "stem string, suffix string")
    assert [r.violates for r in prosody.rhythmic_violations(pairs).collect()] == [False, True, False, None]


def test_small_sources(spark, tmp_path):
    from wordloom.operators import discovery
    from wordloom.sources import texts

    (tmp_path / "x.json").write_text('{"schema_version": 1, "first_members": [{"form": "auto", "kind": "bound"}, {"form": "foto", "kind": null}]}')
    found = texts.json_inventory(spark, str(tmp_path / "x.json"), "schema_version int, first_members array<struct<form:string,kind:string>>", "first_members")
    assert [tuple(r) for r in found.collect()] == [("auto", "bound"), ("foto", None)]
    lines = texts.training_lines(spark.createDataFrame([("Mama", [2]), ("mama", [2]), ("vlk", [])], "word string, points array<int>"))
    assert {r.value for r in lines.collect()} == {"ma-ma", "vlk"}
    texts.write_lines(lines, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["ma-ma", "vlk"]
    rows = spark.createDataFrame([(x,) for x in "dcba"], "form string")
    order = spark.createDataFrame([(3, "a"), (1, "c"), (2, "d"), (4, "c")], "position int, form string")
    assert [r.form for r in texts.in_worklist_order(rows, order).collect()] == ["c", "d", "a"]
    many = spark.range(100).withColumnRenamed("id", "k")
    block = sorted(r.k for r in discovery.contiguous_block(many, 10, "seed", "k").collect())
    assert block == list(range(block[0], block[0] + 10)) and block != sorted(r.k for r in discovery.contiguous_block(many, 10, "other", "k").collect())
    assert discovery.contiguous_block(many, 200, "seed", "k").count() == 100
    nouns, verbs = spark.createDataFrame([("dom", "dom"), ("dom", "dom")], "word string, lemma string"), spark.createDataFrame([("volať",)], "word string")
    assert {tuple(r) for r in discovery.lexicon_evidence({"nouns": nouns, "names": None, "verbs": verbs}).collect()} == {("dom", "dom", "nouns"), ("volať", None, "verbs")}
    entries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "entry_id int, raw_text string")
    variants = spark.createDataFrame([(1, "dokt-or", "doktor"), (1, "dokt-or", "doktor")], "entry_id int, notation string, surface string")
    spans = spark.createDataFrame([(2, "doktor", "root"), (2, "doktor", "root"), (1, "doktor", "root"), (3, "doktor", "other")], "entry_id int, surface string, role string")
    exact, spanned = discovery.role_lookup(entries, variants, spans, "doktor", "root")
    assert [tuple(r) for r in exact.collect()] == [(1, "a", "dokt-or")] and {tuple(r) for r in spanned.collect()} == {(1, "a", "dokt-or"), (2, "b", None)}


def test_seams_from_lexicons(spark):
    from wordloom.operators import morphology as M

    one = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    words = one("word", "odísť", "podzemie", "neohraničený", "viacfarebný", "krátkosti", "mama", "rozum", "Bezohľadný", "trikrát")
    prefixes, stems = one("prefix", "od", "pod", "ne", "o", "bez", "roz"), one("stem", "ísť", "zem", "hranič", "ohraničený", "ohľad")
    found = [M.prefix_seams(words, prefixes, stems), M.compound_seams(words, one("form", "viac", "krátko"), one("stem", "fareb", "zrak")), M.suffix_seams(words, one("suffix", "krát", "sti", "ti"), one("stem", "tri"))]
    at = {r.word: r.seams for r in M.seams(words, found, spark.createDataFrame([("rozum", [])], "word string, seams array<int>")).collect()}
    assert at == {"odísť": [2], "podzemie": [3], "neohraničený": [2, 3], "viacfarebný": [4], "krátkosti": [], "mama": [], "rozum": [], "Bezohľadný": [3], "trikrát": [3]}
    out = {r.word: r for r in M.divided(words, M.seams(words, found)).collect()}
    cut = lambda w: "·".join(w[a:b] for a, b in zip([0, *out[w].preferred], [*out[w].preferred, len(w)], strict=True))
    assert [cut(w) for w in ("odísť", "podzemie", "viacfarebný", "trikrát", "mama")] == ["od·ísť", "pod·ze·mie", "viac·fa·reb·ný", "tri·krát", "ma·ma"]
    shapes = one("t", "strom", "ák", "ktk", "rvt", "")
    assert [r[0] for r in shapes.select(M.starts_like_a_word(F.col("t"))).collect()] == [False, True, False, False, True]
    price = M.priced({"po": 50, "učka": 20, "mama": 5})
    rows = spark.createDataFrame([("poučka", 2), ("poučka", 3), ("mama", 2), ("", 0)], "w string, k int").select(price("w", "k").alias("v")).collect()
    assert rows[0].v.prefers and rows[0].v.cuts and not rows[1].v.prefers and not rows[1].v.cuts and not rows[2].v.prefers and rows[3].v is None
    assert abs(rows[2].v.price - (math.log(75) - math.log(5)) / 4) < 1e-9
