"""Text sources: type inventories, book bodies, worklists, prose (SRC-1 .. SRC-7, SRC-11 .. SRC-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import text as X


def inventory(forms: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Forms that no adjudication has retired (SRC-1)."""
    joined = forms.join(adjudications.select("form", "review_status"), "form", "left")
    return joined.filter(F.coalesce("review_status", F.lit("pending")) != "invalid")


def vocabulary(forms: DataFrame, alphabet: str = r"^\p{L}+$", least: int = 2) -> DataFrame:
    """form, reason of a casing-checked vocabulary; reason is null for accepted words, each once (SRC-2)."""
    lower = F.replace(F.lower("form"), F.lit("ß"), F.lit("ss"))
    reason = F.when(~F.col("casing_status").isin("resolved", "inferred"), "casing").when(~lower.rlike(alphabet), "alphabet").when(F.length(lower) < least, "length")
    rows = forms.select(lower.alias("form"), reason.alias("reason"))
    return rows.groupBy("form", "reason").agg(F.count("*").alias("n"))


def types(docs: DataFrame, *by: str) -> DataFrame:
    """word, n for every distinct token of docs(text), by the given columns (SRC-3)."""
    return docs.select(*by, F.explode(X.tokens(F.col("text"))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))


def project_texts(projects: DataFrame, chapters: DataFrame, paragraphs: DataFrame, names: list[str]) -> DataFrame:
    """Paragraph texts of the named projects; a missing project is an error (SRC-4, SRC-5)."""
    wanted = projects.filter(F.col("name").isin(*names))
    enough = wanted.agg(F.count_distinct("name").alias("n")).select(F.assert_true(F.col("n") == len(set(names)), "unknown project").alias("ok"))
    chosen = wanted.crossJoin(F.broadcast(enough)).filter("ok is null")  # one row
    return chosen.join(chapters, "project_id").join(paragraphs, "chapter_id").select("name", F.col("source_text").alias("text"))


def book_body(text: Column) -> Column:
    """What stands between the only start and the only end marker of a public e-book; null otherwise (SRC-6, SRC-7)."""
    start, end = r"\*\*\* START OF TH[^\n]*\*\*\*", r"\*\*\* END OF TH[^\n]*\*\*\*"
    once = (F.regexp_count(text, F.lit(start)) == 1) & (F.regexp_count(text, F.lit(end)) == 1)
    body = F.regexp_extract(text, f"(?s){start}(.*?){end}", 1)
    return F.when(once, body)


def exclusions(*tables: DataFrame) -> DataFrame:
    """Distinct folded forms of whichever earlier tables there are (SRC-11)."""
    rows = [t.select(F.lower("form").alias("form")) for t in tables if t is not None]
    out = rows[0]
    for t in rows[1:]:
        out = out.union(t)
    return out.distinct()


def line_clusters(words: DataFrame, gap: float = 2.0) -> DataFrame:
    """page, line, text of words(page, top, left, text): a line holds words at most gap below its first word (SRC-12).

    The gap counts from the line's first word, so lines are a fold over a page's words in order of top.
    """
    rows = words.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("top", "left", "text"))).alias("w"))
    empty = F.array().cast("array<array<struct<top:double,left:double,text:string>>>")

    def step(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        joins = (F.size(lines) > 0) & (w["top"] - F.get(last, F.lit(0))["top"] <= gap)
        grown = F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat(last, F.array(w))))
        return F.when(joins, grown).otherwise(F.concat(lines, F.array(F.array(w))))

    words_of = F.aggregate(F.transform("w", lambda x: F.struct(x["top"].cast("double").alias("top"), x["left"].cast("double").alias("left"), x["text"].cast("string").alias("text"))), empty, step)
    lines = rows.select("page", F.posexplode(words_of).alias("line", "w"))
    ordered = F.array_sort(F.transform("w", lambda x: F.struct(x["left"].alias("left"), x["text"].alias("text"))))
    return lines.select("page", "line", F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def prose_words(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, place, word, recased: words of running text, with the capital that a sentence forces undone (SRC-15).

    A capital stays only where the same word also stands capitalised inside a sentence of the text; shouted words are lowered
    and are no evidence.
    """
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line", "t")).filter(~F.ltrim("t").startswith("#"))
    sentences = lines.select(key, "line", F.posexplode(F.split("t", X.SENTENCE_END)).alias("sentence", "t"))
    words = sentences.select(key, "line", "sentence", F.posexplode(F.regexp_extract_all("t", F.lit(X.PROSE_WORD), F.lit(0))).alias("place", "word"))
    shouting = (F.upper("word") == F.col("word")) & (F.lower("word") != F.col("word")) & (F.length("word") > 1)
    words = words.withColumn("shouting", shouting)
    inside = words.filter((F.col("place") > 0) & ~F.col("shouting")).select(key, "word").distinct().withColumn("inside", F.lit(True))
    first = F.substring("word", 1, 1)
    capital = (first != F.lower(first)) & (first == F.upper(first))
    out = words.join(inside, [key, "word"], "left")
    lowered = capital & (F.col("shouting") | ((F.col("place") == 0) & F.col("inside").isNull()))
    return out.select(key, "line", "sentence", "place", F.when(lowered, F.lower("word")).otherwise(F.col("word")).alias("word"), lowered.alias("recased"), "shouting")


def worklist(upload: DataFrame, known: DataFrame) -> DataFrame:
    """token, position, form, status of an upload(position, token): known by exact form, then by lower case; else addable or not (SRC-16, JN-4).

    Repeats keep their first position.
    """
    first = upload.groupBy("token").agg(F.min("position").alias("position"))
    exact = known.select(F.col("form").alias("exact"))
    folded = known.groupBy(F.lower("form").alias("key")).agg(F.min("form").alias("folded"))
    rows = first.join(exact, F.col("token") == F.col("exact"), "left").join(folded, F.lower("token") == F.col("key"), "left")
    form = F.coalesce("exact", "folded")
    status = F.when(form.isNotNull(), "known").when(X.is_addable(F.col("token")), "addable").otherwise("rejected")
    return rows.select("token", "position", form.alias("form"), status.alias("status"))


def append_unseen(forms: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows to append: addable tokens that no form, retired or not, holds (SNK-1)."""
    new = tokens.filter(X.is_addable(F.col("token"))).select(F.col("token").alias("form")).distinct()
    return new.join(forms.select("form"), "form", "left_anti")


def first_seen(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in the given order (DD-2)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def json_inventory(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """The rows of an array field of one JSON document, read whole by a schema; other fields are dropped (SRC-10)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", schema)[rows]).alias("r")).select("r.*")


def training_lines(rows: DataFrame) -> DataFrame:
    """value: dictionary lines of rows(word, points) for a pattern learner, hyphens at points, each once (SNK-5); written by write_lines."""
    return rows.select(X.hyphenate(F.lower("word"), F.col("points"), "-").alias("value")).distinct()


def write_lines(lines: DataFrame, path: str) -> None:
    """One sorted text file a partition; an existing folder is an error (SNK-5)."""
    lines.orderBy("value").write.mode("errorifexists").text(path)


def in_worklist_order(rows: DataFrame, upload: DataFrame, key: str = "form") -> DataFrame:
    """Rows of a worklist(position, key) in its order, which replaces their own (SO-3); the first position of a key counts."""
    first = upload.groupBy(key).agg(F.min("position").alias("position"))
    return rows.join(first, key).orderBy("position")
