"""Further registered queries: division inputs, sounds, snapshots, review and foreign evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import phonology as P
from wordloom.functions import text as X
from wordloom.operators import changes, console, discovery, foreign, ngrams, review
from wordloom.plans.queries import RAW, TYPES, _raw_forms, _table, _types, query
from wordloom.session import saved
from wordloom.sources import texts
from wordloom.streaming import events as streams

WORDS = f"select distinct word from ({TYPES})"
POINTS = "list_filter(range(1, length(word)), lambda p: substr(word, p, 1) in ('a', 'e', 'i', 'o', 'u'))"


def _words(spark: SparkSession, d: str) -> DataFrame:
    """word and a point behind every plain vowel but a last one: given divisions for operators that take them."""
    behind = F.transform(F.split("word", ""), lambda x, i: F.when((i + 1 < F.length("word")) & x.isin("a", "e", "i", "o", "u"), i + 1))
    return _types(spark, d).select("word").withColumn("p", F.array_compact(behind))


def _marked(points: str, word: str = "word") -> str:
    return f"array_to_string(list_transform(range(0, len({points}) + 1), lambda i: substr({word}, case when i = 0 then 1 else {points}[i] + 1 end, case when i = len({points}) then length({word}) else {points}[i + 1] end - case when i = 0 then 0 else {points}[i] end)), '·')"


@query(f"""with w as (select word, {POINTS} p from ({WORDS})), e as (select word, p, list_filter(p, lambda x: x >= 2 and x <= length(word) - 3) inner_p from w)
    select word, array_to_string(inner_p, ',') inner_points, {_marked('p', "translate(word, 'aeiou', 'AEIOU')")} recased, {_marked('inner_p')} marked, array_to_string(p, ',') offsets from e""")
def edge_minima(spark: SparkSession, d: str) -> DataFrame:
    """Points within margins, parts in the form's own casing, offsets read back from marks (FLT-6, FLT-9, DIV-2)."""
    rows, w = _words(spark, d), F.col("word")
    inner = X.within(F.col("p"), w, 2, 3)
    offsets = F.array_join(X.offsets_of(X.hyphenate(w, F.col("p"))).cast("array<string>"), ",")
    return rows.select("word", F.array_join(inner.cast("array<string>"), ",").alias("inner_points"), X.recase(X.parts_of(w, F.col("p")), F.translate(w, "aeiou", "AEIOU")).alias("recased"), X.hyphenate(w, inner).alias("marked"), offsets.alias("offsets"))


@query(f"""with w as (select word, {POINTS} p from ({WORDS})), t as (select word, {_marked('p')} m from w), u as (select word, m, ' -' || replace(m, '·', ' - ') || case when length(word) % 2 = 0 then '- ' else 'x' end typed from t)
    select word, case when length(word) % 2 = 0 then m end canonical, array_to_string(list_sort(list_distinct([m, word])), ' ') variants from u""")
def typed_divisions(spark: SparkSession, d: str) -> DataFrame:
    """Typed divisions in canonical form where their letters are the word's, and a reviewer's variants (FLT-8, FLT-10)."""
    rows = _words(spark, d).select("word", X.hyphenate(F.col("word"), F.col("p")).alias("m"))
    typed = F.concat(F.lit(" -"), F.replace("m", F.lit("·"), F.lit(" - ")), F.when(F.length("word") % 2 == 0, "- ").otherwise("x"))
    given = F.array(F.concat(F.lit(" "), "m"), F.replace("m", F.lit("·"), F.lit("-")), F.lit("-"), F.col("word"))
    return rows.select("word", X.parse_marked(F.col("word"), typed).alias("canonical"), F.array_join(F.array_sort(X.variants(given)), " ").alias("variants"))


@query("select case lang when 'en' then 'english' when 'de' then 'german' when 'fr' then 'french' when 'es' then 'slovak' end as language, count(*) n from documents group by 1")
def full_language_names(spark: SparkSession, d: str) -> DataFrame:
    """Labels as full names (FLT-11); the fourth language stands in for the fourth name."""
    label = F.when(F.col("lang") == "es", " SK ").otherwise(F.col("lang"))
    return _table(spark, d, "documents").select(X.language(label).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


@query(f"""with w as (select word, {POINTS} p from ({WORDS})), t as (select word, p, list_sort(list_distinct(list_concat(p[2:], case when length(word) % 3 = 0 then [length(word)] else [1] end))) after from w where len(p) > 0),
    e as (select *, list_sort(list_distinct(list_concat(list_filter(p, lambda x: x <> p[1]), [1]))) want from t)
    select word, 'transition' problem from e where want <> after union all select word, 'range' from e where len(list_filter(after, lambda x: x < 1 or x >= length(word))) > 0
    union all select word, 'order' from e where length(word) % 5 = 0 and list_sort(list_distinct(list_reverse(after))) <> list_reverse(after) union all select word, 'repeated' from e where length(word) = 4""")
def snapshot_problems(spark: SparkSession, d: str) -> DataFrame:
    """Transitions that do not add up, and points out of range, out of order or repeated (ST-4, ST-5)."""
    rows = _words(spark, d).withColumn("after", F.array_sort(F.array_distinct(F.concat(F.slice("p", 2, F.size("p")), F.when(F.length("word") % 3 == 0, F.array(F.length("word"))).otherwise(F.array(F.lit(1)))))))
    # saved, as each problem's condition would be pushed down to all tokens, and its branch would read all documents
    rows = saved(rows, "snapshot").filter(F.size("p") > 0)
    wrong = changes.wrong_transitions(rows.select(F.col("word").alias("form"), F.col("p").alias("before"), "after", F.slice("p", 1, 1).alias("remove"), F.array(F.lit(1)).alias("add")))
    points = F.when(F.length("word") % 5 == 0, F.reverse("after")).otherwise(F.col("after"))
    snapshot = rows.select(F.col("word").alias("form"), points.alias("points"))
    snapshot = snapshot.union(snapshot.filter(F.length("form") == 4))
    found = changes.invalid_points(snapshot).distinct()
    return wrong.select(F.col("form").alias("word"), F.lit("transition").alias("problem")).union(found.select("form", "problem"))


@query(f"""with w as (select word, min(lang) a, max(lang) b from ({TYPES}) group by word), r as (select word, a human, case when length(word) % 5 <> 0 then a end before, case when length(word) % 7 <> 0 then b end as after from w)
    select count_if(before is null and after is not null)::bigint gained, count_if(before is not null and after is null)::bigint lost, count_if(before <> after)::bigint changed, count_if(before = human and after is distinct from human)::bigint lost_human from r""")
def routing_difference(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a routing difference against the human labels (ST-7)."""
    rows = _types(spark, d, "lang").groupBy(F.col("word").alias("form")).agg(F.min("lang").alias("a"), F.max("lang").alias("b"))
    rows = saved(rows, "routes")  # both sides of the difference come from it
    before = rows.select("form", F.when(F.length("form") % 5 != 0, F.col("a")).alias("language"), F.col("a").alias("human"))
    return changes.routing_changes(before, rows.select("form", F.when(F.length("form") % 7 != 0, F.col("b")).alias("language")))


@query(f"select count_if(lang = 'de' and word like '%en')::bigint hits, round(count_if(lang = 'de' and word like '%en') / count_if(word like '%en'), 6) as precision, round(count_if(lang = 'de' and word like '%en') / count_if(lang = 'de'), 6) recall, round(avg((word like '%en')::int), 6) flag_rate from ({TYPES})")
def flag_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of a flag against a class (AG-4)."""
    out = ngrams.binary_metrics(_types(spark, d, "lang"), F.col("lang") == "de", F.endswith("word", F.lit("en")))
    return out.select("hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "flag_rate")])


def _among(values) -> str:
    return "phoneme in (" + ", ".join(f"'{x}'" for x in values) + ")"


def _mapped(table: dict[str, str]) -> str:
    return "case phoneme " + " ".join(f"when '{a}' then '{b}'" for a, b in table.items()) + " end"


_SOUNDS = "regexp_extract_all(word, '(?s:dž|ch|dz|ia|ie|iu|.)')"


@query(f"""with p as (select distinct unnest({_SOUNDS}) phoneme from ({WORDS}))
    select phoneme, {_among(P.VOWELS + P.FOREIGN_VOWELS)} vowel, {_among([*P.CONSONANTS, *P.FOREIGN_CONSONANTS])} consonant, {_among(P.DIPHTHONGS)} diphthong, {_among(P.HARD)} hard, {_among(P.SOFT)} soft, {_among(P.VOICED)} voiced, {_among(P.VOICED.values())} voiceless,
        {_mapped(P.VOICED | {b: a for a, b in P.VOICED.items()})} pair, {_mapped(P.PALATAL)} palatal, {_mapped(P.LINGUAL_DORSAL)} dorsal, translate(phoneme, 'aeiouy', 'áéíóúý') long, translate(phoneme, 'ßçř', 'ssr') native from p""")
def sound_table(spark: SparkSession, d: str) -> DataFrame:
    """Every sound that occurs with its classes and partners (PHO-3, PHO-4, PHO-6, PHO-7, PHO-9, PHO-10)."""
    rows = _types(spark, d).select(F.explode(P.phonemes(F.col("word"))).alias("phoneme")).distinct()
    x = F.col("phoneme")
    classes = {"vowel": P.is_vowel, "consonant": P.is_consonant, "diphthong": P.is_diphthong, "hard": P.is_hard, "soft": P.is_soft, "voiced": P.is_voiced, "voiceless": P.is_voiceless, "pair": P.voice_pair, "palatal": P.palatalised, "dorsal": P.lingual_dorsal, "long": P.lengthen, "native": P.native_spelling}
    return rows.select("phoneme", *[f(x).alias(name) for name, f in classes.items()])


_SINGLE = "".join(c for c in P.CONSONANTS if len(c) == 1 and c not in "rlŕĺ") + "".join(P.FOREIGN_CONSONANTS)
_LETTERS = "".join(P.NATIVE_LETTERS + P.FOREIGN_VOWELS + list(P.FOREIGN_CONSONANTS))


@query(f"""select lang, count(*) words, count_if(regexp_matches(word, '[{"".join(P.NATIVE_LETTERS)}q]') and len(list_filter({_SOUNDS}, lambda x: x in ({", ".join(repr(v) for v in [*P.VOWELS, *P.DIPHTHONGS, "r", "l", "ŕ", "ĺ"])}))) > 0 and not regexp_matches(word, '(dž|ch|dz|[{_SINGLE}]){{5}}'))::bigint plausible,
    count_if(regexp_matches(word, '^[{_LETTERS}]+$'))::bigint divisible, count_if(regexp_matches(word, '^[{_LETTERS}qw]+$'))::bigint analysable, sum(length(word) - length(replace(word, 'qu', 'q')))::bigint merged from ({TYPES}) group by lang""")
def plausible_words(spark: SparkSession, d: str) -> DataFrame:
    """Plausible and divisible spellings; qu as one consonant (PHT-1, PHO-12, SYL-7)."""
    w = F.col("word")
    return _types(spark, d, "lang").groupBy("lang").agg(
        F.count("*").alias("words"), F.count_if(P.is_plausible(w)).alias("plausible"), F.count_if(P.is_hyphenatable(w)).alias("divisible"), F.count_if(P.is_analysable(w)).alias("analysable"), F.sum(F.length(w) - F.length(P.merge_qu(w))).alias("merged")
    )


@query("select case when n_chars % 3 = 0 then 'cut' when n_chars % 3 = 1 then 'whole' else 'twice' end kind, count(*) n, count_if(n_chars % 3 = 1)::bigint bodies, coalesce(sum(length(text) + 2) filter (where n_chars % 3 = 1), 0)::bigint n_letters from documents where text is not null group by 1")
def book_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Texts between the only pair of markers (SRC-6, SRC-7); some lack one, some repeat one."""
    start, end = F.lit("*** START OF THIS BOOK ***\n"), F.lit("\n*** END OF THIS BOOK ***")
    kind = F.when(F.col("n_chars") % 3 == 0, "cut").when(F.col("n_chars") % 3 == 1, "whole").otherwise("twice")
    wrapped = F.when(F.col("n_chars") % 3 == 0, F.concat(start, "text")).when(F.col("n_chars") % 3 == 1, F.concat(F.lit("before"), start, "text", end)).otherwise(F.concat(start, "text", end, end))
    rows = _table(spark, d, "documents").filter("text is not null").select(kind.alias("kind"), texts.book_body(wrapped).alias("body"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("body").alias("bodies"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n_letters"))


@query(r"""with l as (select lang, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r][ \t\n\v\f\r]+[^ \t\n\v\f\r]') and not starts_with(ltrim(x, ' '), '#')) t from documents where text is not null)
    select lang, count(*) n, count_if(len(t) > 0 and len(list_filter(t, lambda x: regexp_matches(x, '[.,;:!?…"„“”‚‘’»«()]'))) * 2 >= len(t))::bigint prose from l group by lang""")
def prose_documents(spark: SparkSession, d: str) -> DataFrame:
    """Running text told from column tables (SRC-14)."""
    rows = _table(spark, d, "documents").filter("text is not null")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(X.looks_like_prose(F.col("text"))).alias("prose"))


@query(rf"""with f as ({RAW}), known as (select form from f where n > 1), t as (select distinct w token from (select unnest(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) w from benchmark))
    select token form, lower(token) folded from t where length(token) <= 60 and regexp_matches(token, '^\p{{L}}([\p{{L}}\-''’]*\p{{L}})?$') and token not in (select form from known)""")
def appended_forms(spark: SparkSession, d: str) -> DataFrame:
    """New rows of an inventory: addable tokens that no form holds (SNK-1)."""
    tokens = _table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))).alias("token"))
    rows = texts.append_unseen(_raw_forms(spark, d).filter("n > 1").select("form"), tokens)
    return rows.select("form", F.lower("form").alias("folded"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) k from events) where k = 1")
def first_events(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key (DD-2)."""
    rows = _table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return texts.first_seen(rows, F.struct("user_id", "event_type"), "ts", "event_id").select("user_id", "event_id", "event_type")


@query(f"select distinct lower(form) form from (select form from ({RAW}) where n > 2 union all select word from ({TYPES}) where n = 1)")
def excluded_forms(spark: SparkSession, d: str) -> DataFrame:
    """Folded forms of earlier tables, of which one is missing (SRC-11)."""
    return texts.exclusions(_raw_forms(spark, d).filter("n > 2").select("form"), None, _types(spark, d, "lang").filter("n = 1").select(F.col("word").alias("form")))


@query("""with i as (select doc_id, source form from documents where doc_id is not null), a as (select doc_id, case when quality = 1 then (select any_value(source) from documents d where d.doc_id = labels.doc_id) else 'other' end form from labels)
    select coalesce(i.doc_id, a.doc_id) as position, case when a.form is null then 'missing' when i.form is null then 'unexpected' else 'other_form' end problem from i full join a on i.doc_id = a.doc_id where a.form is null or i.form is null or i.form <> a.form""")
def submission_check(spark: SparkSession, d: str) -> DataFrame:
    """A submission against its batch: missing, unexpected and other forms (AUD-6, AI-1)."""
    items = _table(spark, d, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("position"), F.col("source").alias("form"))
    answers = _table(spark, d, "labels").select(F.col("doc_id").alias("position"), "quality").join(items, "position", "left")
    return discovery.submission_problems(items, answers.select("position", F.when(F.col("quality") == 1, F.col("form")).otherwise("other").alias("form")))


@query("select case when l.quality is null then 'unscored' when d.lang in ('en', 'fr') then 'match' else 'mismatch' end outcome, count(*) n from labels l left join documents d using (doc_id) group by 1")
def audit_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers' variants against the engine (AUD-7)."""
    decisions = _table(spark, d, "labels").select(F.col("doc_id").alias("form"), F.when(F.col("quality").isNull(), "uncertain").otherwise("resolved").alias("assessment"), F.array(F.lit("en"), F.lit("fr")).alias("variants"))
    engine = _table(spark, d, "documents").select(F.col("doc_id").alias("form"), F.col("lang").alias("division"))
    return discovery.audit_report(decisions, engine).groupBy("outcome").agg(F.sum("n").alias("n"))


@query(f"""with w as (select word, {POINTS} p from ({WORDS})), s as (select word, unnest(p) seam, strpos(word, 'then') - 1 a from w)
    select word, seam, a as start, a + 4 as "end" from s where a >= 0 and seam > a and seam < a + 4""")
def seams_in_roots(spark: SparkSession, d: str) -> DataFrame:
    """Division points inside a dictionary root (AUD-9, JN-11)."""
    rows = _words(spark, d)
    at = F.instr("word", "then") - 1
    spans = rows.select("word", at.alias("start"), (at + 4).alias("end"), F.lit("root").alias("role")).filter("start >= 0")
    return discovery.root_conflicts(rows.select("word", F.col("p").alias("points")), spans)


@query("""with s as (select conv_id, string_agg(substr(text, 1, 3), ' ' order by turn, substr(text, 1, 3)) spans from conversations where role = 'user' group by conv_id) select c.conv_id entry_id, s.spans from (select distinct conv_id from conversations) c left join s using (conv_id)""")
def entry_spans(spark: SparkSession, d: str) -> DataFrame:
    """Entries with their spans of one role in order (JN-15)."""
    rows = _table(spark, d, "conversations")
    spans = rows.select(F.col("conv_id").alias("entry_id"), F.col("turn").alias("position"), F.substring("text", 1, 3).alias("text"), "role")
    return discovery.spans_text(rows.select(F.col("conv_id").alias("entry_id")).distinct(), spans, "user")


@query("select doc_id form from (select doc_id, case when n_chars % 2 = 0 then 'uncertain' else 'confirm' end a, n_chars % 3 = 0 gone from documents) where a = 'uncertain' and not gone and doc_id not in (select doc_id from labels where doc_id is not null)")
def open_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Uncertain, live decisions without a verdict (AI-7, JN-5)."""
    decisions = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("form"), F.when(F.col("n_chars") % 2 == 0, "uncertain").otherwise("confirm").alias("action"), (F.col("n_chars") % 3 == 0).cast("int").alias("is_deleted"))
    rows = review.review_queue(decisions, _table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("form")))
    return rows.select(F.col("form").cast("long").alias("form"))


@query("""with k as (select distinct text, sha256(text) h from conversations where role = 'user' and text is not null), r as (select distinct text from conversations where text is not null)
    select sha256(r.text) request_hash, k.h is not null known from r left join k on sha256(r.text) = k.h""")
def cached_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests against an immutable cache (AI-4)."""
    rows = _table(spark, d, "conversations").filter("text is not null")
    first = rows.filter("role = 'user'").select(F.col("text").alias("request"), F.lit("yes").alias("response"), F.lit("done").alias("state"), F.col("turn").alias("order"))
    cache = review.cache_put(spark.createDataFrame([], "request_hash string, request string, response string, state string"), first, "order")
    found = review.cached(rows.select(F.col("text").alias("request")).distinct(), cache)
    return found.select(F.sha2("request", 256).alias("request_hash"), F.col("response").isNotNull().alias("known"))


@query("select distinct sha256(lang) sha256, substr(lang, 1, 1) as version from documents where lang <> 'en'")
def new_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Dimension rows to append; the same text under another version would be an error (AI-6)."""
    rows = _table(spark, d, "documents").filter("lang is not null").select(F.sha2("lang", 256).alias("sha256"), F.substring("lang", 1, 1).alias("version"), "lang")
    return review.new_dimension_rows(rows.filter("lang = 'en'").select("sha256", "version").distinct(), rows.select("sha256", "version").distinct())


@query("""select user_id batch_id, max_by(event_id, struct_pack(a := ts, b := event_id)) holder from events where ts + interval 30 minute > (select max(ts) - interval 1 day from events) group by user_id""")
def live_leases(spark: SparkSession, d: str) -> DataFrame:
    """Claims that still hold a day before the newest (STR-2, AUD-5)."""
    rows = _table(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("claim_token"), F.col("ts").alias("claimed_at"))
    now = rows.agg((F.max("claimed_at") - F.expr("interval 1 day")).alias("t")).first()["t"]
    return streams.leases(rows, now)


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where quality = 1 and doc_id is not null) order by doc_id limit 500")
def next_rows(spark: SparkSession, d: str) -> DataFrame:
    """The next batch of rows that are not done (STR-4, FOR-15)."""
    done = _table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "done").otherwise("error").alias("status"))
    return streams.pending_rows(_table(spark, d, "documents").select("doc_id", "source"), done, "doc_id")


@query("""with r as (select conv_id form, turn, role model_id, case when length(text) % 3 = 0 then null else length(text) % 2 end preferred, case when length(text) % 5 = 0 then 'accept' when length(text) % 7 = 0 then 'uncertain' else 'revise' end vote from conversations),
    f as (select form, count(distinct preferred) kinds, min(preferred) same, count(*) n, bool_or(preferred is null) bad from r where turn <= 1 group by form),
    v as (select form, min(turn - 1) filter (where vote = 'accept') a, min(turn - 1) filter (where vote = 'uncertain') u from r where turn between 2 and 5 group by form),
    s as (select f.form, same, a, case when bad or n <> 2 then 'invalid_response' when kinds = 1 then 'agreed_independent' when a is not null and (u is null or a < u) then 'agreed_after_review' when u is not null then 'uncertain' else 'unresolved_disagreement' end status from f left join v using (form))
    select status, count(*) n from s group by status""")
def consensus_status(spark: SparkSession, d: str) -> DataFrame:
    """Two models' answers by their consensus (AI-2)."""
    n = F.length("text")
    rows = _table(spark, d, "conversations").select(F.col("conv_id").alias("form"), F.greatest(F.col("turn") - 1, F.lit(0)).alias("turn"), F.col("role").alias("model_id"), F.when(n % 3 != 0, n % 2).alias("preferred"), F.when(n % 5 == 0, "accept").when(n % 7 == 0, "uncertain").otherwise("revise").alias("vote"))
    return review.consensus(rows).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""with w as (select word, {POINTS} p, length(word) n from ({WORDS})), e as (select word form, n, p, case when n % 5 <> 0 then 'x' end phones, n % 3 <> 0 complete, case when n % 11 = 0 then 'bad' end error from w)
    select case when error is not null then 'error' when phones is not null then 'generated' else 'pending' end pronunciation_status, case when error is not null then 'error' when phones is null then 'pending' when not complete then 'incomplete' when len(p) > 0 then 'candidate' else 'experimental' end proposal_status, count(*) n from e group by all""")
def evidence_states(spark: SparkSession, d: str) -> DataFrame:
    """Status columns of foreign evidence (FOR-14)."""
    n = F.length("word")
    rows = _words(spark, d).select(F.col("word").alias("form"), F.col("p").alias("points"), F.when(n % 5 != 0, "x").alias("phones"), (n % 3 != 0).alias("complete"), F.when(n % 11 == 0, "bad").alias("error"))
    return foreign.evidence_row(rows).groupBy("pronunciation_status", "proposal_status").agg(F.count("*").alias("n"))


@query(f"""with r as (select word form, lang, length(word) n, count(*) over (partition by word) k from (select distinct word, lang from ({TYPES})))
    select distinct form, problem from (select form, unnest([case when k > 1 then 'repeated' end, case when n % 4 = 0 then 'letters' end, case when n % 5 = 0 then 'status' end]) problem from r) where problem is not null""")
def evidence_problems(spark: SparkSession, d: str) -> DataFrame:
    """Repeated forms, divisions with other letters, contradicting statuses (FOR-16)."""
    n = F.length("word")
    rows = _types(spark, d, "lang").select(F.col("word").alias("form"), F.when(n % 4 == 0, F.concat("word", F.lit("·x"))).otherwise(F.col("word")).alias("proposed_hyphenation"), F.lit("generated").alias("pronunciation_status"), F.when(n % 5 != 0, "x").alias("phones"), F.lit(None).cast("string").alias("error"))
    return foreign.inventory_problems(rows).distinct()


@query(f"""with w as (select word, {POINTS} p, length(word) n from ({WORDS}))
    select word form, {_marked('p')} before, {_marked('case when n % 2 = 0 then p[2:] else p end')} as after from w where n % 7 <> 0 and n % 2 = 0 and len(p) > 0""")
def reprojections(spark: SparkSession, d: str) -> DataFrame:
    """Proposals that a new projection changes; reviewed forms are left out (FOR-18)."""
    rows, n = _words(spark, d), F.length("word")
    stored = rows.select(F.col("word").alias("form"), X.hyphenate(F.col("word"), F.col("p")).alias("division"), F.when(n % 7 == 0, True).alias("reviewed"))
    fresh = rows.withColumn("q", F.when(n % 2 == 0, F.slice("p", 2, F.greatest(F.size("p"), F.lit(1)))).otherwise(F.col("p")))
    return foreign.reprojection_plan(stored, fresh.select(F.col("word").alias("form"), X.hyphenate(F.col("word"), F.col("q")).alias("division")))


@query(f"""with w as (select lang as language, case when length(word) % 3 = 0 then null when word like '%en' then 'de' else 'en' end routed from ({TYPES}))
    select *, round(case when "right" + wrong = 0 then 1 else "right" / ("right" + wrong) end, 6) accuracy, round("right" / words, 6) capture from (select language, count(*) words, count_if(routed = language)::bigint "right", count_if(routed <> language)::bigint wrong, count_if(routed is null)::bigint unrouted from w group by language)""")
def route_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Routing of types by language (AG-9)."""
    routed = F.when(F.length("word") % 3 == 0, None).when(F.endswith("word", F.lit("en")), "de").otherwise("en")
    rows = foreign.routing_metrics(_types(spark, d, "lang").select(F.col("lang").alias("language"), routed.alias("routed")))
    return rows.select("language", "words", "right", "wrong", "unrouted", *[F.round(c, 6).alias(c) for c in ("accuracy", "capture")])


STEMS, ENDINGS = ("than", "there", "auch", "mais", "entre"), ("s", "ly", "en", "es", "ed")


@query(f"""with w as ({WORDS}), s as (select unnest({list(STEMS)}) stem), e as (select unnest({list(ENDINGS)}) ending),
    a as (select word, stem, '' ending from w join s on word = stem), b as (select word, substr(word, 1, i) stem, substr(word, i + 1) ending from (select word, unnest(range(3, length(word))) i from w where length(word) > 3 and word not in (select word from a)))
    select word, stem, ending, 'xx' as language from a union all select word, stem, ending, 'xx' from b join s using (stem) join e using (ending)""")
def stem_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings of words as listed stems with listed endings (FOR-1)."""
    stems = spark.createDataFrame([(s, "xx", True) for s in STEMS], "stem string, language string, inflects boolean")
    return ngrams.readings(_types(spark, d).select("word").distinct(), stems, spark.createDataFrame([(e,) for e in ENDINGS], "ending string"))


_FR, _GERMAN = foreign.VOWELS, foreign.LETTERS["german"].replace("'", "''")


@query(f"""with w as (select word, {POINTS} p, length(word) n from ({WORDS}) where regexp_matches(word, '^[{_GERMAN}]+$')),
    m as (select word, n, p, list_filter(p, lambda x: regexp_matches(substr(word, 1, x), '[{_FR}]t$') and regexp_matches(substr(word, x + 1), '^z[{_FR}]') or regexp_matches(substr(word, 1, x), '[{_FR}][lmnr]s$') and regexp_matches(substr(word, x + 1), '^t[{_FR}]')) moved from (select word, n, range(1, n) p from w)),
    o as (select word, n, list_sort(list_distinct(list_concat(list_filter(p, lambda x: not list_contains(moved, x)), list_transform(moved, lambda x: x - 1)))) q from m)
    select word, array_to_string(list_filter(q, lambda x: x >= 2 and x <= n - 2), ',') points from o""")
def german_adaptation(spark: SparkSession, d: str) -> DataFrame:
    """Points adapted by the German spelling rules, every place given as a point (FOR-4)."""
    rows = _types(spark, d).select("word").distinct()
    raw = F.filter(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda p: p < F.length("word"))
    found = rows.select("word", foreign.adapt(F.col("word"), F.lit("german"), raw).alias("v")).filter("v.error is null")
    return found.select("word", F.array_join(F.col("v.points").cast("array<string>"), ",").alias("points"))


@query(f"""select case when length(word) % 4 = 0 then 'preferred' when length(word) % 4 = 1 then 'permissive' when length(word) % 4 = 2 then 'contextual' end mode, count(*) n from ({WORDS}) group by 1""")
def output_modes(spark: SparkSession, d: str) -> DataFrame:
    """The first mode that gives an expected division (FLT-7)."""
    n = F.length("word")
    modes = [F.when(n % 4 == k, F.col("word")).otherwise("-") for k in (0, 1, 2)]
    return _types(spark, d).select("word").distinct().groupBy(console.first_mode(F.col("word"), *modes, F.lit("-")).alias("mode")).agg(F.count("*").alias("n"))


@query(f"""with f as (select form from ({RAW})), s as (select form, length(form) n from f), good as (select form from s where n % 3 <> 0 or n % 2 = 0)
    select case when n % 5 = 0 then 'unknown action' when n % 3 = 0 and n % 2 = 1 then 'a correction needs a division' when n % 2 = 0 and n % 7 = 0 then 'the letters differ from the form' else 'accepted' end outcome, count(*) n from s group by 1""")
def judged_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decision events, each accepted or refused with its reason (REV-1, REV-2)."""
    n = F.length("form")
    action = F.when(n % 5 == 0, "dance").when(n % 3 == 0, "correct").otherwise("confirm")
    typed = F.when((n % 2 == 0) & (n % 7 == 0), "0").when(n % 2 == 0, F.col("form"))
    good, bad = console.decide(_raw_forms(spark, d).select("form", action.alias("action"), typed.alias("typed")))
    return good.select(F.lit("accepted").alias("outcome")).union(bad.select("problem")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""with l as (select conv_id, turn, 1000 * turn + 1 file_ord, text from conversations where role = 'user' and text is not null)
    select conv_id::varchar form, max(turn)::varchar variants from l group by conv_id""")
def blind_files(spark: SparkSession, d: str) -> DataFrame:
    """Blind verdict files merged, later ones winning (REV-7)."""
    rows = _table(spark, d, "conversations").filter("role = 'user' and text is not null")
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("form"), F.array(F.col("turn").cast("string")).alias("variants")))
    found = console.blind_verdicts(rows.select((1000 * F.col("turn") + 1).alias("file_ord"), line.alias("line")))
    return found.select("form", F.array_join("variants", ",").alias("variants"))
