"""The registered queries over the driver's tables, each with its SQL where SQL can express it.

The tables hold invented prose in four languages; the queries exercise the operators on them, they say nothing about Slovak.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import phonology as P
from wordloom.functions import prosody
from wordloom.functions import text as X
from wordloom.operators import changes, discovery, grammar, liang, ngrams, review
from wordloom.plans import patterns
from wordloom.session import saved, ship
from wordloom.sources import tex, texts
from wordloom.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, d: (ship(spark), f(spark, d))[1]
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _types(spark: SparkSession, d: str, *by: str, least: int = 1) -> DataFrame:
    rows = texts.types(_table(spark, d, "documents"), *by)
    # tied to n, as the condition would be pushed down to all tokens
    return rows.filter(F.when(F.col("n") > 0, F.col("word").rlike(X.LETTERS) & (F.length("word") >= least)))


def _points(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nl}\p{No}]+')"
TYPES = f"select lang, word, count(*) n from (select lang, unnest({TOKENS}) word from documents) where regexp_matches(word, '^\\p{{L}}+$') group by all"
TOKEN_ROWS = f"select doc_id, generate_subscripts(t, 1) - 1 as pos, unnest(t) as token from (select doc_id, {TOKENS} t from documents)"


def _values(weights) -> str:
    return ", ".join(f"('{f}', {o}, {w})" for f, o, w in weights)


def _liang_sql(name: str, weights, words: str, left: int = 2, right: int = 3) -> str:
    """CTEs that end in name(word, points); the fragments' cap comes from the weights themselves."""
    return f"""
    {name}_w(frag, off, w) as (values {_values(weights)}),
    {name}_p as (select word, '.' || word || '.' p from {words}),
    {name}_f as (select word, i - 1 as place, substr(p, i, n) frag from (select word, p, unnest(range(1, length(p) + 1)) i from {name}_p), (select unnest(range(1, (select max(length(frag)) from {name}_w) + 1)) n) where i + n - 1 <= length(p)),
    {name}_v as (select word, place + off - 1 as pos, max(w) v from {name}_f join {name}_w using (frag) group by all),
    {name} as (select word, coalesce(list_sort(list(pos) filter (where v % 2 = 1 and pos >= {left} and pos <= length(word) - {right})), []::int[]) points from (select word from {words}) left join {name}_v using (word) group by word)"""


OPEN, AWARE = tex.pattern_weights(patterns.open_syllables()), tex.pattern_weights(patterns.cluster_aware())


@query(f"""
    with types as ({TYPES}), words as (select distinct word from types where length(word) >= 3),
    {_liang_sql('a', OPEN, 'words')}, {_liang_sql('b', AWARE, 'words')},
    m as (select lang, a.points e, b.points x from types join a using (word) join b using (word)),
    s as (select lang, count(*) words, avg((e = x)::int::double) exact, sum(len(list_intersect(e, x)))::bigint good, sum(len(list_filter(x, lambda p: not list_contains(e, p))))::bigint bad, sum(len(list_filter(e, lambda p: not list_contains(x, p))))::bigint missed from m group by lang),
    r as (select *, case when good + bad = 0 then 1 else good / (good + bad) end prec, case when good + missed = 0 then 1 else good / (good + missed) end rec from s)
    select lang, words, round(exact, 6) exact, good, bad, missed, round(prec, 6) as precision, round(rec, 6) recall, round(case when prec / 49.0 + rec = 0 then 0 else (1 + 1 / 49.0) * prec * rec / (prec / 49.0 + rec) end, 6) f_beta from r""")
def liang_agreement_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Two pattern sets against each other, by language (LIA-1, LIA-6, AG-2, JN-12)."""
    types = _types(spark, d, "lang", least=3)
    words = types.select("word").distinct()
    a = liang.break_points(words, tex.weights_frame(spark, patterns.open_syllables())).withColumnRenamed("points", "e")
    b = liang.break_points(words, tex.weights_frame(spark, patterns.cluster_aware())).withColumnRenamed("points", "x")
    out = liang.agreement(types.join(a, "word").join(b, "word"), "e", "x", "lang")
    return out.select("lang", "words", F.round("exact", 6).alias("exact"), "good", "bad", "missed", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f_beta")])


@query(f"""
    with types as ({TYPES}), words as (select distinct word from types where length(word) >= 3), {_liang_sql('a', AWARE, 'words', 2, 2)}
    select word, array_to_string(points, ',') points,
        array_to_string(list_transform(range(0, len(points) + 1), lambda i: substr(word, case when i = 0 then 1 else points[i] + 1 end, case when i = len(points) then length(word) else points[i + 1] end - case when i = 0 then 0 else points[i] end)), '·') marked,
        array_to_string(list_transform(points, lambda p: substr(word, 1, p) || '-' || substr(word, p + 1)), ' ') divisions from a""")
def liang_divisions(spark: SparkSession, d: str) -> DataFrame:
    """Points, marked form and divisions of every type (LIA-2, DIV-2, DIV-3, FOR-5)."""
    words = _types(spark, d, least=3).select("word").distinct()
    rows = liang.break_points(words, tex.weights_frame(spark, patterns.cluster_aware()), 2, 2)
    rows = rows.withColumnRenamed("points", "p")
    w, p = F.col("word"), F.col("p")
    return rows.select("word", _points("p").alias("points"), X.hyphenate(w, p).alias("marked"), F.array_join(X.divisions(w, p), " ").alias("divisions"))


@query(f"select lang, count(*) types, sum(n)::bigint tokens, max(length(word)) longest from ({TYPES}) group by lang")
def type_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Types and tokens by language (SRC-3)."""
    return _types(spark, d, "lang").groupBy("lang").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.max(F.length("word")).cast("long").alias("longest"))


@query(f"select lang, count(*) n from (select word, min(lang) lang from ({TYPES}) group by word having count(distinct lang) = 1) group by lang")
def unique_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of one language only (DD-1)."""
    return ngrams.unique_types(_types(spark, d, "lang")).groupBy("lang").agg(F.count("*").alias("n"))


@query(r"""select case when not casing in ('resolved', 'inferred') then 'casing' when not regexp_matches(form, '^\p{L}+$') then 'alphabet' when length(form) < 2 then 'length' else 'kept' end reason, count(distinct form) forms, count(*) n
    from (select replace(lower(w), 'ß', 'ss') form, case when w = lower(w) then 'resolved' when substr(w, 2) = lower(substr(w, 2)) then 'inferred' else 'needs_review' end casing
    from (select unnest(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) w from documents)) group by all""")
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary scan with counted rejects (SRC-2)."""
    rows = _table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))).alias("form"))
    w = F.col("form")
    rows = rows.withColumn("casing_status", F.when(w == F.lower(w), "resolved").when(F.substring(w, 2, 1 << 30) == F.lower(F.substring(w, 2, 1 << 30)), "inferred").otherwise("needs_review"))
    return texts.vocabulary(rows).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("forms"), F.sum("n").alias("n"))


PHONEMES = "regexp_extract_all(word, '(?s:dž|ch|dz|ia|ie|iu|.)')"


@query(f"select phoneme, count(*) n, count(distinct word) words from (select word, unnest({PHONEMES}) phoneme from (select distinct word from ({TYPES}))) group by phoneme")
def phoneme_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Sounds of all types (PHO-1)."""
    rows = _types(spark, d).select("word", F.explode(P.phonemes(F.col("word"))).alias("phoneme"))
    return rows.groupBy("phoneme").agg(F.count("*").alias("n"), F.count_distinct("word").alias("words"))


_LIKE = ", ".join(f"'{x}'" for x in P.VOWEL_LIKE)


@query(f"""with w as (select lang, word, {PHONEMES} s from ({TYPES})),
    k as (select lang, word, len(list_filter(range(1, len(s) + 1), lambda i: s[i] in ({_LIKE}, 'ŕ', 'ĺ') or (s[i] in ('r', 'l') and i < len(s) and s[i + 1] not in ({_LIKE}) and (i = 1 or s[i - 1] not in ({_LIKE}))))) nuclei from w)
    select lang, nuclei, count(*) words from k group by all""")
def nucleus_count(spark: SparkSession, d: str) -> DataFrame:
    """Types by number of nuclei (SYL-3)."""
    rows = _types(spark, d, "lang").select("lang", F.size(P.nuclei(P.phonemes(F.col("word")))).cast("long").alias("nuclei"))
    return rows.groupBy("lang", "nuclei").agg(F.count("*").alias("words"))


_LONG = "|".join(P.DIPHTHONGS + P.LONG + P.LONG_CONSONANTS)
_NATIVE = "".join(P.NATIVE_LETTERS)


@query(f"select lang, count(*) words, count_if(regexp_matches(word, '{_LONG}'))::bigint long, count_if(regexp_matches(word, '^[{_NATIVE}]+$'))::bigint native, count_if(regexp_matches(word, '^[aeiouyäáéíóúý]'))::bigint vowel_initial, sum(length(translate(word, 'áéíóúý', 'aeiouy')) - length(replace(translate(word, 'áéíóúý', 'aeiouy'), 'a', '')))::bigint short_a from ({TYPES}) group by lang")
def sound_classes(spark: SparkSession, d: str) -> DataFrame:
    """Long syllables, native spelling, vowel onsets, shortened a (PHO-2 .. PHO-8, PHO-12, PHT-3)."""
    w = F.col("word")
    short = P.shorten(w)
    return _types(spark, d, "lang").groupBy("lang").agg(
        F.count("*").alias("words"),
        F.count_if(P.is_long_syllable(w)).alias("long"),
        F.count_if(P.is_native(w)).alias("native"),
        F.count_if(P.is_short_vowel(F.left(w, F.lit(1))) | P.is_long_vowel(F.left(w, F.lit(1)))).alias("vowel_initial"),
        F.sum(F.length(short) - F.length(F.replace(short, F.lit("a"), F.lit("")))).alias("short_a"),
    )


@query(f"""with f(phoneme, feature, value) as (values {", ".join(str(x) for x in P.feature_rows())})
    select lang, feature, value, count(*) n from (select lang, unnest({PHONEMES}) phoneme from ({TYPES})) join f using (phoneme) group by all""")
def sound_features(spark: SparkSession, d: str) -> DataFrame:
    """Sounds by feature class, from a dimension table (PHO-11)."""
    table = spark.createDataFrame(P.feature_rows(), "phoneme string, feature string, value string")
    rows = _types(spark, d, "lang").select("lang", F.explode(P.phonemes(F.col("word"))).alias("phoneme"))
    return rows.join(F.broadcast(table), "phoneme").groupBy("lang", "feature", "value").agg(F.count("*").alias("n"))  # the table is fixed


@query(f"""with t as ({TOKEN_ROWS}), p as (select token, lead(token) over (partition by doc_id order by pos) nxt from t)
    select token, count(*) n, count_if((token = 'v' and regexp_extract(nxt, '^(dž|ch|dz|ia|ie|iu|.)') in ('v', 'f')) or (token in ('s', 'z') and regexp_extract(nxt, '^(dž|ch|dz|ia|ie|iu|.)') in ('s', 'z', 'š', 'ž')) or (token = 'k' and regexp_extract(nxt, '^(dž|ch|dz|ia|ie|iu|.)') in ('k', 'g')))::bigint violations
    from p where token in ('v', 's', 'z', 'k', 'a', 'de', 'la') and nxt is not null group by token""")
def preposition_violations(spark: SparkSession, d: str) -> DataFrame:
    """Forms that needed vocalising before the next word (PHT-5)."""
    words = _table(spark, d, "documents").select(X.tokens(F.col("text")).alias("t"))
    pairs = words.select(F.explode(F.transform(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("token"), F.get("t", i + 1).alias("nxt")))).alias("p")).select("p.*")
    pairs = pairs.filter(F.col("token").isin("v", "s", "z", "k", "a", "de", "la"))
    return pairs.groupBy("token").agg(F.count("*").alias("n"), F.count_if(~P.preposition_fits(F.col("token"), F.col("nxt"))).alias("violations"))


@query(f"""select lang, count(*) words, count_if(len(s) >= 2 and list_contains(c, s[-1]) and list_contains(c, s[-2]) and s[-1] not in ('ŕ', 'ĺ') and s[-2] not in ('ŕ', 'ĺ') and not (s[-2] in ('r', 'l') and len(s) >= 3 and list_contains(c, s[-3])))::bigint two from (select lang, {PHONEMES} s, {P.CONSONANTS + list(P.FOREIGN_CONSONANTS)} c from ({TYPES})) group by lang""")
def final_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Types that close with two consonants (PHT-4)."""
    return _types(spark, d, "lang").groupBy("lang").agg(F.count("*").alias("words"), F.count_if(P.ends_with_two_consonants(P.phonemes(F.col("word")))).alias("two"))


SALT = "wordloom"
BUCKET = f"('0x' || substr(sha256('{SALT}:' || substr(strip_accents(replace(word, 'ß', 'ss')), 1, 5)), 1, 8))::bigint % 100"
SPLIT = f"select *, case when {BUCKET} < 70 then 'train' when {BUCKET} < 85 then 'calibration' else 'test' end part from (select word, min(lang) lang from ({TYPES}) group by word having count(distinct lang) = 1) where length(word) >= 3"


def _split_types(spark: SparkSession, d: str) -> DataFrame:
    """word, lang, part; saved, as a choice of parts would be pushed down to all tokens and every use would read the documents."""
    rows = ngrams.unique_types(_types(spark, d, "lang", least=3))
    return saved(rows.withColumn("part", ngrams.family_bucket(F.col("word"), SALT)), "split")


@query(f"select lang, part, count(*) n from ({SPLIT}) group by all")
def family_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Types by split, families together (LNG-10)."""
    return _split_types(spark, d).groupBy("lang", "part").agg(F.count("*").alias("n"))


def _grams_sql(word: str) -> str:
    m = f"('^' || {word} || '$')"
    return "flatten([" + ", ".join(f"list_transform(range(1, greatest(length({m}) - {n} + 2, 1)), lambda i: substr({m}, i, {n}))" for n in ngrams.SIZES) + "])"


ROUTER = f"""split as ({SPLIT}), g as (select lang, unnest({_grams_sql('word')}) gram from split where part = 'train'), c as (select lang, gram, count(*) c from g group by all),
    tot as (select lang, sum(c) n from c group by lang), keep as (select gram from c group by gram having sum(c) >= 5),
    weights as (select keep.gram, tot.lang, round(ln((coalesce(c.c, 0) + 0.05) / (tot.n + 0.1)), 6) weight from keep cross join tot left join c on c.gram = keep.gram and c.lang = tot.lang)"""


@query(f"with {ROUTER} select lang, count(*) grams, round(sum(weight), 1) total, round(max(weight), 4) most from weights group by lang")
def router_weights(spark: SparkSession, d: str) -> DataFrame:
    """Fitted additive weights, summed up (LNG-11, AG-5)."""
    weights = ngrams.router_weights(_split_types(spark, d).filter("part = 'train'"))
    return weights.groupBy("lang").agg(F.count("*").alias("grams"), F.round(F.sum("weight"), 1).alias("total"), F.round(F.max("weight"), 4).alias("most"))


@query(f"""with {ROUTER}, s as (select word, lang actual, unnest({_grams_sql('word')}) gram from split where part = 'test'),
    sc as (select word, actual, weights.lang lang, round(sum(weight::decimal(18, 6)), 6)::double score from s join weights using (gram) group by all),
    top as (select * from (select *, row_number() over (partition by word order by score desc, lang) k from sc) where k = 1),
    cells as (select actual, lang predicted, count(*) n from top group by all)
    select actual, predicted, n, round(sum(case when actual = predicted then n else 0 end) over (partition by actual) / sum(n) over (partition by actual), 6) accuracy from cells""")
def router_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Held-out types by language and decision (LNG-1, LNG-2, AG-3, JN-13)."""
    rows = _split_types(spark, d)
    weights = saved(ngrams.router_weights(rows.filter("part = 'train'")), "weights")  # read for the languages and for the scores
    test = rows.filter("part = 'test'")
    best = ngrams.detected(ngrams.router_scores(test.select("word"), weights)).withColumnRenamed("lang", "predicted")
    out = ngrams.confusion(test.join(best, "word"), "lang", "predicted")
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(f"""with split as ({SPLIT}), x as (select lang, word from split where lang in ('de', 'en') and part = 'train'), n as (select count_if(lang = 'de')::bigint n1, count_if(lang = 'en')::bigint n0 from x),
    w as (select gram, round(ln((count_if(lang = 'de')::bigint + 0.5) / (any_value(n1) + 1)) - ln((count_if(lang = 'en')::bigint + 0.5) / (any_value(n0) + 1)), 6) weight from (select lang, unnest(list_distinct({_grams_sql('word')})) gram from x), n group by gram having count(*) >= 3),
    f as (select word, lang, list_distinct({_grams_sql('word')}) f from split where part = 'test'),
    e as (select word, any_value(lang) lang, any_value(len(f)) features, count(weight) support, sum(weight::decimal(18, 6))::double total from (select word, lang, f, unnest(f) gram from f) left join w using (gram) group by word),
    s as (select lang, case when support > 0 then round(total / support, 6) else -100 end score, support, round(support / features, 6) coverage from e),
    h as (select lang, score >= 1.75 and support >= 2 and coverage >= 0.5 flagged from s)
    select lang, count(*) words, count_if(flagged)::bigint flagged from h group by lang""")
def profile_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Held-out types that a binary profile flags (LNG-3 .. LNG-6, LNG-12, LNG-13, AG-4, AG-6)."""
    rows = _split_types(spark, d)
    weights = ngrams.profile(rows.filter("part = 'train'"), "de", "en")
    test = rows.filter("part = 'test'")
    found = ngrams.evidence(test.select("word"), weights, 1.75)
    return test.join(found, "word").groupBy("lang").agg(F.count("*").alias("words"), F.count_if("flagged").alias("flagged"))


@query(f"""with split as ({SPLIT}), x as (select lang, word from split where lang in ('de', 'en')), n as (select count_if(lang = 'de')::bigint n1, count_if(lang = 'en')::bigint n0 from x),
    l as (select letter, count_if(lang = 'de')::bigint c1, count_if(lang = 'en')::bigint c0 from (select lang, unnest(list_distinct(string_split(word, ''))) letter from x) where letter <> '' group by letter)
    select letter, c1, c0 from l, n where c1 >= 10 and (c0 = 0 or c1 * n0 >= 5.0 * c0 * n1)""")
def informative_letters(spark: SparkSession, d: str) -> DataFrame:
    """Letters that tell two languages apart (AG-7)."""
    return ngrams.informative_letters(_split_types(spark, d), "de", "en")


@query("select doc_id, lang from documents order by sha256('seed:' || coalesce(lang, '') || ':' || doc_id), lang, doc_id limit 50")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of fixed size (SO-4)."""
    rows = _table(spark, d, "documents").select("doc_id", "lang", F.coalesce("lang", F.lit("")).alias("a"), F.col("doc_id").cast("string").alias("b"))
    return review.hash_sample(rows, 50, "seed", "a", "b").select("doc_id", "lang")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k = 1")
def latest_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    """Newest row of each key by time, then id (WN-1, WN-3, WN-4)."""
    rows = _table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return review.latest(rows, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query(r"""with n as (select distinct w form from (select unnest(regexp_extract_all(coalesce(text, ''), '\p{L}+')) w from documents)), r as (select n.form, coalesce(t.form, n.form) representative from n left join n t on t.form = lower(n.form)),
    a as (select form, representative, case length(form) % 3 when 0 then 'verified' when 1 then 'human_review' else 'pending' end review_status from r),
    o as (select *, row_number() over (partition by representative order by case review_status when 'human_review' then 2 when 'verified' then 3 else 5 end, form <> representative, form) k from a)
    select representative, form, review_status from o where k = 1""")
def effective_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """Each representative's binding adjudication: by status rank, its own form first (WN-2, SO-7, JN-7)."""
    forms = _raw_forms(spark, d).select("form")
    status = F.when(F.length("form") % 3 == 0, "verified").when(F.length("form") % 3 == 1, "human_review").otherwise("pending")
    return review.effective_adjudication(forms.select("form", status.alias("review_status")), review.representatives(forms))


@query("""with e as (select user_id, event_id, case when event_id % 3 = 0 then 1 else -1 end step from events),
    h as (select *, sum(step) over newest height from e window newest as (partition by user_id order by event_id desc)),
    l as (select *, least(coalesce(min(height) over (partition by user_id order by event_id desc rows between unbounded preceding and 1 preceding), 0), 0) low from h)
    select user_id, count_if(step = -1 and height < low)::int live, coalesce(string_agg(event_id::varchar, ',' order by event_id) filter (where step = -1 and height < low), '') ids from l group by user_id""")
def undo_fold(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that stand after undo, a user's events as a log (REV-2 .. REV-4, STR-1)."""
    op = F.when(F.col("event_id") % 3 == 0, "undo").otherwise("decide")
    rows = _table(spark, d, "events").select("user_id", "event_id", op.alias("operation"))
    return review.undo_state(rows, "user_id", "event_id").select("user_id", F.size("live").alias("live"), F.array_join(F.col("live").cast("array<string>"), ",").alias("ids"))


@query("select run_id, form, model_id, preferred from (select 0 run_id, conv_id form, role model_id, text preferred, row_number() over (partition by conv_id, role order by turn desc, text desc) k from conversations where text is not null) where k = 1")
def last_turn_per_role(spark: SparkSession, d: str) -> DataFrame:
    """Each speaker's last valid message of a run (WN-5)."""
    answers = _table(spark, d, "conversations").select(F.lit(0).alias("run_id"), F.col("conv_id").alias("form"), F.col("role").alias("model_id"), F.concat(F.lit("turn "), "turn").alias("stage"), F.col("text").alias("preferred"), F.lit(None).cast("string").alias("error"))
    return review.final_proposals(answers)


@query("select role, count(*) n, count(distinct conv_id) conversations from conversations group by role")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows by status (AG-1, AG-13)."""
    return _table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


@query("""select case when toxic = 1 then 'invalid' when quality = 1 then 'verified' else 'pending' end status, count(*) n from documents left join labels using (doc_id) where toxic is distinct from 1 group by all""")
def live_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Left join with a default status, retired rows dropped (SRC-1, JN-1, AG-1, AG-13)."""
    status = F.when(F.col("toxic") == 1, "invalid").when(F.col("quality") == 1, "verified").otherwise("pending")
    adjudications = _table(spark, d, "labels").select(F.col("doc_id").alias("form"), status.alias("review_status"))
    rows = texts.inventory(_table(spark, d, "documents").select(F.col("doc_id").alias("form")), adjudications)
    return rows.groupBy(F.coalesce("review_status", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def unlabelled_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a match (JN-5, SRC-11, AI-7)."""
    return _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


BEFORE = "select word, count(distinct lang) langs from ({0}) where lang in ('en', 'de') group by word"
AFTER = "select word, count(distinct lang) langs from ({0}) where lang in ('en', 'fr') group by word"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    types = _types(spark, d, "lang")
    return tuple(types.filter(F.col("lang").isin(*x)).groupBy("word").agg(F.count_distinct("lang").alias("langs")) for x in (("en", "de"), ("en", "fr")))


@query(f"""with a as ({BEFORE.format(TYPES)}), b as ({AFTER.format(TYPES)})
    select word, case when a.word is null then 'added' when b.word is null then 'removed' else 'changed' end kind, case when a.word is not null then '{{"langs":' || a.langs || '}}' end before, case when b.word is not null then '{{"langs":' || b.langs || '}}' end as after
    from a full join b using (word) where a.langs is distinct from b.langs""")
def snapshot_difference(spark: SparkSession, d: str) -> DataFrame:
    """Added, removed and changed rows of two snapshots (ST-1, ST-2, JN-8, ST-9)."""
    return changes.difference(*_snapshots(spark, d), "word")


@query(f"""with a as ({BEFORE.format(TYPES)}), b as ({AFTER.format(TYPES)}),
    c as (select word, a.langs x, b.langs y from a full join b using (word) where a.langs is distinct from b.langs),
    ok as (select * from c where length(word) > 4 union all select 'zzz-stale', 1, 2 union all select * from c where length(word) = 9)
    select word, 'unapproved' problem from c where length(word) <= 4 union all select 'zzz-stale', 'stale' union all select word, 'duplicate' from c where length(word) = 9""")
def allowlist_gate(spark: SparkSession, d: str) -> DataFrame:
    """Unapproved, stale and repeated approvals (ST-3, ST-8)."""
    found = changes.difference(*_snapshots(spark, d), "word").select("word", "before", "after")
    stale = spark.createDataFrame([("zzz-stale", '{"langs":1}', '{"langs":2}')], "word string, before string, after string")
    allowed = found.filter(F.length("word") > 4).union(stale).union(found.filter(F.length("word") == 9))
    return changes.gate(found, allowed, "word")


@query(f"select lang, sha256(string_agg(word, chr(10) order by word) || chr(10)) hash, count(*) n from ({TYPES}) group by lang")
def set_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash of each language's sorted types (AG-16, SNK-8)."""
    return _types(spark, d, "lang").groupBy("lang").agg(changes.set_hash("word").alias("hash"), F.count("*").alias("n"))


@query("select source, array_to_string(list_sort(list(distinct lang)), ',') labels from documents group by source having count(distinct lang) > 1")
def conflicting_labels(spark: SparkSession, d: str) -> DataFrame:
    """Keys with several labels (SNK-7)."""
    return changes.conflicting_labels(_table(spark, d, "documents"), "source", "lang").select("source", F.array_join("labels", ",").alias("labels"))


PROSE = r"'\p{L}+(?:[-''’]\p{L}+)*'"


@query(rf"""with l as (select conv_id, turn, role, generate_subscripts(x, 1) line, unnest(x) t from (select conv_id, turn, role, string_split(text, chr(10)) x from conversations)),
    s as (select conv_id, turn, role, line, generate_subscripts(x, 1) sentence, unnest(x) t from (select *, regexp_split_to_array(t, '[.!?…]+') x from l where not starts_with(ltrim(t, ' '), '#'))),
    w as (select conv_id, turn, role, generate_subscripts(x, 1) - 1 place, unnest(x) word from (select *, regexp_extract_all(t, {PROSE}) x from s)),
    i as (select *, upper(word) = word and lower(word) <> word and length(word) > 1 shout from w),
    n as (select distinct conv_id, turn, role, word from i where place > 0 and not shout),
    o as (select i.*, n.word is not null inside from i left join n using (conv_id, turn, role, word)),
    r as (select *, substr(word, 1, 1) <> lower(substr(word, 1, 1)) and substr(word, 1, 1) = upper(substr(word, 1, 1)) and (shout or (place = 0 and not inside)) recased from o)
    select role, count(*) words, count_if(recased)::bigint recased, count_if(shout)::bigint shouted from r group by role""")
def prose_recase(spark: SparkSession, d: str) -> DataFrame:
    """Words of running text with forced capitals undone (SRC-14, SRC-15)."""
    rows = _table(spark, d, "conversations").select(F.concat_ws("|", "conv_id", "turn", "role").alias("doc_id"), "role", "text")
    words = texts.prose_words(rows.select("doc_id", "text"))
    words = words.join(rows.select("doc_id", "role").distinct(), "doc_id")
    return words.groupBy("role").agg(F.count("*").alias("words"), F.count_if("recased").alias("recased"), F.count_if("shouting").alias("shouted"))


@query("select doc_id, lang, (select count(*) from documents) total from documents order by lang, doc_id limit 100 offset 50")
def page_window(spark: SparkSession, d: str) -> DataFrame:
    """A page in total order with the total (SO-1 .. SO-3)."""
    return review.page(_table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", offset=50, limit=100)


@query(f"""select mode, count(*) n from (select word, strip_accents(replace(word, 'ß', 'ss')) k, unnest(['prefix', 'suffix', 'contains', 'exact', 'regex']) mode from (select distinct word from ({TYPES})))
    where case mode when 'prefix' then starts_with(k, 'el') when 'suffix' then ends_with(k, 'el') when 'contains' then contains(k, 'el') when 'exact' then k = 'el' else regexp_matches(word, '(?i)^e.*n$') end group by mode""")
def folded_search(spark: SparkSession, d: str) -> DataFrame:
    """Search on folded forms, all modes (FLT-1, FLT-2)."""
    modes = ("prefix", "suffix", "contains", "exact", "regex")
    found = _types(spark, d).agg(*[F.count_if(X.matches(F.col("word"), "^e.*n$" if m == "regex" else "él", m)).alias(m) for m in modes])  # one pass for all
    cells = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("n")) for m in modes])
    return found.select(F.inline(cells)).filter("n > 0")


@query(r"""select lang, count(*) words, count_if(length(w) <= 60 and regexp_matches(w, '^\p{L}([\p{L}\-''’]*\p{L})?$'))::bigint addable, count(distinct w) forms from (select lang, unnest(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) w from documents) group by lang""")
def addable_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that may enter an inventory (SRC-17)."""
    rows = _table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))).alias("w"))
    return rows.groupBy("lang").agg(F.count("*").alias("words"), F.count_if(X.is_addable(F.col("w"))).alias("addable"), F.count_distinct("w").alias("forms"))


RAW = r"select w form, count(*) n from (select unnest(regexp_extract_all(coalesce(text, ''), '\p{L}+')) w from documents) group by w"


def _raw_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+"), F.lit(0))).alias("form"))
    return rows.groupBy("form").agg(F.count("*").alias("n"))


@query(f"""with f as ({RAW}), r as (select f.form, coalesce(t.form, f.form) representative from f left join f t on t.form = lower(f.form))
    select representative, array_to_string(list_sort(list(form)), ' ') aliases from r group by representative having count(*) > 1""")
def alias_groups(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised forms under their lower-case twins (JN-6, JN-7, DD-3)."""
    rows = review.aliases(review.representatives(_raw_forms(spark, d))).filter(F.size("aliases") > 1)
    return rows.select("representative", F.array_join("aliases", " ").alias("aliases"))


@query(f"""with known as (select form from ({RAW}) where n > 1), up as (select unnest(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) token from benchmark),
    f as (select distinct token from up), k as (select lower(form) key, min(form) folded from known group by 1)
    select case when known.form is not null or k.folded is not null then 'known' when length(token) <= 60 and regexp_matches(token, '^\\p{{L}}([\\p{{L}}\\-''’]*\\p{{L}})?$') then 'addable' else 'rejected' end status, count(*) n
    from f left join known on token = known.form left join k on lower(token) = k.key group by status""")
def worklist_status(spark: SparkSession, d: str) -> DataFrame:
    """An uploaded word list against the inventory (SRC-16, SNK-1, JN-4)."""
    known = _raw_forms(spark, d).filter("n > 1").select("form")
    upload = _table(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))).alias("position", "token"))
    return texts.worklist(upload.select("position", "token"), known).groupBy("status").agg(F.count("*").alias("n"))


#: Forms a member must lie in.
SUPPORT = 3


@query(f"""with f as (select distinct word form from ({TYPES})), c as (select form, i - 1 as place, substr(form, i, n) member from (select form, i, unnest(range(1, length(form) - i + 2)) n from (select form, unnest(range(1, length(form) + 1)) i from f)) where n < length(form)),
    g as (select member, count(distinct c.form) forms, count(distinct substr(c.form, 1, place)) contexts from c join f on c.member = f.form group by member)
    select member, forms, contexts, round(2 * forms * contexts / (forms + contexts), 6) score from g where forms >= {SUPPORT}""")
def member_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Members of any length inside forms of any length, all languages; only support bounds them (AUD-8, JN-10, AG-11, AG-12, FLT-12)."""
    forms = saved(_types(spark, d).select(F.col("word").alias("form")), "forms")
    found = discovery.discovered(discovery.members_inside(forms, forms.select(F.col("form").alias("member")), 1))
    return found.filter(F.col("forms") >= SUPPORT).select("member", "forms", "contexts", F.round("score", 6).alias("score"))


@query(f"""with w as (select distinct word from ({TYPES})) select affix, count(*) n from (select word, unnest(list_filter(['an', 'be', 'ge', 'ver', 'über', 'inter'], lambda a: starts_with(word, a) and length(word) > length(a))) affix from w) group by affix""")
def affix_counts(spark: SparkSession, d: str) -> DataFrame:
    """Types by listed prefix (JN-14)."""
    return discovery.affix_lookup(_types(spark, d).select("word").distinct(), ["an", "be", "ge", "ver", "über", "inter"]).groupBy("affix").agg(F.count("*").alias("n"))


@query(f"""with t as ({TOKEN_ROWS}) select doc_id, pos as at from (select *, lead(token) over (partition by doc_id order by pos) nxt from t) where token = 'of' and nxt = 'the'""")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """A phrase over an inverted table (JN-16)."""
    rows = _table(spark, d, "documents").select("doc_id", F.posexplode(X.tokens(F.col("text"))).alias("position", "token"))
    return discovery.phrase_matches(rows, ["of", "the"]).select("doc_id", F.col("at").cast("long").alias("at"))


@query(f"""with b as (select item_id, list_distinct({TOKENS}) t from benchmark), p as (select x.item_id a, y.item_id b, len(list_intersect(x.t, y.t)) shared, len(list_distinct(list_concat(x.t, y.t))) every from b x join b y on x.item_id < y.item_id)
    select a, b, round(shared / every, 6) similarity from p where every > 0 and shared / every >= 0.03""")
def item_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Similar benchmark items by their words (AUD-2); candidates share a word."""
    rows = _table(spark, d, "benchmark").select("item_id", F.array_distinct(X.tokens(F.col("text"))).alias("t"))
    by = rows.select("item_id", F.size("t").alias("n"), F.explode("t").alias("w"))
    left, right = (by.select(F.col("item_id").alias(k), F.col("n").alias(f"n{k}"), "w") for k in "ab")
    both = left.join(right, "w").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    share = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return both.filter(share >= 0.03).select("a", "b", F.round(share, 6).alias("similarity"))


@query("select doc_id, (k - 1) // 40 + 1 batch_id, (k - 1) % 40 + 1 as position from (select doc_id, row_number() over (order by doc_id nulls first) k from documents)")
def batch_positions(spark: SparkSession, d: str) -> DataFrame:
    """Batches and positions of all documents (WN-7, WN-8, AUD-3)."""
    rows = _table(spark, d, "documents").select("doc_id")
    return discovery.batches(rows, 40, "doc_id").select("doc_id", F.col("batch_id").cast("long").alias("batch_id"), F.col("position").cast("long").alias("position"))


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) k from labels) where (k - 1) % 25 = 0 order by doc_id limit 20")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every n-th row, at most so many (SO-5)."""
    rows = _table(spark, d, "labels").select("doc_id", F.row_number().over(Window.orderBy("doc_id")).alias("k"))
    return rows.filter("(k - 1) % 25 = 0").orderBy("doc_id").limit(20).select("doc_id")


@query("select lang, doc_id, n_chars from (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) k from documents) where k <= 5")
def longest_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Top rows by several keys with a stable tie break (SO-6)."""
    rows = _table(spark, d, "documents").select("lang", "doc_id", "n_chars").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")))
    return rows.filter("k <= 5").drop("k")


@query("""with s as (select lang, least(length(coalesce(text, '')) / 1000.0, 50) x from documents), p as (select b, m from (select unnest([0, 1, 2, 4]) b), (select unnest([0.5, 1, 5, 20]) m))
    select lang, b::double bonus, m::double margin, count_if(x + b >= m)::bigint predicted from s, p group by all""")
def parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Predictions over a 4 x 4 grid of parameters (AG-15)."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("bonus"), F.lit(float(m)).alias("margin")) for b in (0, 1, 2, 4) for m in (0.5, 1, 5, 20)]))
    rows = _table(spark, d, "documents").select("lang", F.least(F.length(F.coalesce("text", F.lit(""))) / 1000.0, F.lit(50.0)).alias("x"), grid.alias("g"))
    return rows.groupBy("lang", "g.bonus", "g.margin").agg(F.count_if(F.col("x") + F.col("g.bonus") >= F.col("g.margin")).alias("predicted"))


@query("""with m as (select doc_id, lang v from documents where lang is not null), b as (select doc_id, case when quality = 1 then 'en' else 'de' end v from labels where quality is not null), e as (select doc_id, case when n_chars % 2 = 0 then 'en' else 'fr' end v from documents),
    r as (select m.v m, b.v b, e.v e from m full join b on m.doc_id = b.doc_id left join e on e.doc_id = coalesce(m.doc_id, b.doc_id))
    select case when m is null then case when b = e then 'blind_engine' else 'blind_only' end when b is null then case when m = e then 'manual_engine' else 'manual_only' end when m = b and b = e then 'all_agree' when m = b then 'engine_differs' when m = e then 'blind_differs' when b = e then 'manual_differs' else 'all_differ' end bucket, count(*) n from r group by bucket""")
def three_voices(spark: SparkSession, d: str) -> DataFrame:
    """Voices of all documents; one is missing only where its label is (REV-8, JN-9, FLT-5)."""
    docs, labels = _table(spark, d, "documents"), _table(spark, d, "labels")
    manual = docs.filter("lang is not null").select(F.col("doc_id").alias("form"), F.col("lang").alias("division"))
    blind = labels.filter("quality is not null").select(F.col("doc_id").alias("form"), F.when(F.col("quality") == 1, "en").otherwise("de").alias("division"))
    engine = docs.select(F.col("doc_id").alias("form"), F.when(F.col("n_chars") % 2 == 0, "en").otherwise("fr").alias("division"))
    return review.reconcile(manual, blind, engine).groupBy("bucket").agg(F.count("*").alias("n"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows, an extra beside the reference's scope (STR-5)."""
    return streams.windowed_counts(_table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query()
def division_struct(spark: SparkSession, d: str) -> DataFrame:
    """Three-level points of every type (DIV-1, DIV-4, DIV-5, DIV-11)."""
    rows = _types(spark, d, least=2).select("word").distinct().withColumn("v", prosody.division_udf("word", F.array().cast("array<int>")))
    return rows.select("word", *[F.array_join(F.col(f"v.{c}").cast("array<string>"), ",").alias(c) for c in ("preferred", "variant", "contextual")], "v.error")


@query()
def syllables(spark: SparkSession, d: str) -> DataFrame:
    """Syllables of every type (SYL-1, SYL-2, SYL-9)."""
    rows = _types(spark, d).select("word").distinct().withColumn("v", prosody.syllables_udf("word"))
    return rows.select("word", F.array_join("v.syllables", "·").alias("syllables"), "v.error")


_PATTERNS = list(grammar.NOUN_PATTERNS)
_VOWELS = ", ".join(f"'{x}'" for x in P.VOWELS + P.FOREIGN_VOWELS)
_LONGER = "case substr(root, spot, 1) " + " ".join(f"when '{a}' then '{b}'" for a, b in grammar.LONGER.items()) + " end"
_CELLS = ", ".join(f"('{name}', {cell}, '{ending}')" for name, (endings, _) in grammar.NOUN_PATTERNS.items() for cell, ending in enumerate(endings.split("|")))


@query(f"""with r as (select distinct word root, {_PATTERNS}[length(word) % {len(_PATTERNS)} + 1] pattern from ({TYPES})), c(pattern, cell, ending) as (values {_CELLS}),
    l as (select *, list_max(list_filter(range(1, length(root) + 1), lambda i: substr(root, i, 1) in ('a', 'e', 'i', 'o', 'u', 'y', 'ä') or (substr(root, i, 1) in ('r', 'l') and (i = 1 or substr(root, i - 1, 1) not in ({_VOWELS}))))) spot from r),
    f as (select pattern, cell, (case when cell = 7 and pattern in ('žena', 'ulica', 'mesto') and spot is not null then substr(root, 1, spot - 1) || {_LONGER} || substr(root, spot + 1) else root end) || ending form from l join c using (pattern))
    select pattern, case when cell < 6 then 'sg' else 'pl' end number, ['nom', 'gen', 'dat', 'acc', 'loc', 'ins'][cell % 6 + 1] as "case", count(*) n, count(distinct form) forms, sum(length(form))::bigint letters, min(form) as "first" from f group by all""")
def paradigm_cells(spark: SparkSession, d: str) -> DataFrame:
    """All types declined as roots, each by a pattern that its length chooses (GRM-1, GRM-5, GRM-6)."""
    pattern = F.get(F.array(*map(F.lit, _PATTERNS)), F.length("word") % len(_PATTERNS))
    roots = saved(_types(spark, d).select(F.col("word").alias("root"), pattern.alias("pattern")), "roots")
    # partitions by the number of forms: their bytes, which Spark would go by, pack many rows into few
    parts = roots.count() * len(grammar.ALL) // grammar.TASK_ROWS + 1
    cells = grammar.paradigms(roots.repartition(parts, "root")).repartition(parts, "pattern", "number", "case", "form").groupBy("pattern", "number", "case")
    return cells.agg(F.count("*").alias("n"), F.count_distinct("form").alias("forms"), F.sum(F.length("form")).alias("letters"), F.min("form").alias("first"))


@query(f"""with n as (select unnest(range(1, 1001)) number), p as (select number, number % 100 low, number // 100 % 10 h from n),
    w as (select number, case when number = 1000 then 'tisíc' else (case h when 0 then '' when 1 then 'sto' when 2 then 'dvesto' else {liang.UNITS}[h + 1] || 'sto' end) || (case when low between 10 and 19 then {liang.TEENS}[low - 9] else {liang.TENS}[low // 10 + 1] || {liang.UNITS}[low % 10 + 1] end) end word from p)
    select number, word, ('0x' || substr(sha256('{SALT}' || chr(0) || word), 1, 2))::int < 51 test from w""")
def cardinal_words(spark: SparkSession, d: str) -> DataFrame:
    """Number words 1 to 1000 with their split (LIA-3, LIA-4)."""
    return liang.cardinals(spark).withColumn("test", liang.is_test(F.col("word"), SALT))


@query()
def learned_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns learned from the number words' divisions (LIA-5)."""
    words = liang.cardinals(spark).select("word")
    targets = words.select("word", prosody.division_udf("word", F.array().cast("array<int>"))["preferred"].alias("points"))
    return liang.learn(targets)


@query()
def induced_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings that own attested forms, from the corpus's own types (GRM-7, GRM-8, WN-6)."""
    corpus = _types(spark, d, least=3).select(F.col("word").alias("form")).distinct()
    return grammar.induced(corpus)
