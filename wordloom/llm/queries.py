"""The registered queries of the operators in this subpackage, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import bpe, html_text, katz, language_id, mixing, quality_rules, token_files, topk_search, toxicity
from wordloom.llm.common import fold, table
from wordloom.llm.jaccard_join import jaccard_components

TOXIC_FROM = 0.3


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")), "doc_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out, and not learned from."""
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = language_id.learn(docs.filter(~held), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = language_id.predict(docs, model, "doc_id")
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out, and not learned from."""
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held))
    rows = toxicity.score(docs, grammar, "doc_id")
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


def op7_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_html_extraction": op2_html_extraction,
        "op3_language_id": op3_language_id,
        "op4_toxicity": op4_toxicity,
        "op5_topk_search": op5_topk_search,
        "op6_token_files": op6_token_files,
        "op7_katz_scoring": op7_katz_scoring,
        "op8_bpe": op8_bpe,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_source_mixing": op10_source_mixing,
    }


_VECTORS = """select row_number() over () as place, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as units from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)"""
TOP_K_SQL = f"""with v as materialized ({_VECTORS}),
    scores as (select q.place, q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.units, v.units), lambda z: z[1] * z[2])) as score
        from v q join v on q.place <> v.place and len(q.units) = len(v.units) where q.vec_id % 20 = 0),
    ranked as (select *, row_number() over (partition by place order by score desc, vec_id) as n from scores)
    select query_id, cast(n as integer) as rank, vec_id, cast(score as bigint) as score from ranked where n <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk_search": TOP_K_SQL}
