"""TeX pattern files: reader, digit weights, writer (SRC-9, SNK-4)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHTS = T.StructType([T.StructField("frag", T.StringType(), False), T.StructField("off", T.IntegerType(), False), T.StructField("w", T.IntegerType(), False)])


def parse_tex(text: str) -> tuple[dict[str, str], dict[str, list[int]]]:
    r"""Keys with their digit strings, and exception words with their points; the last of equal keys counts.

    % starts a comment; \patterns{...} and \hyphenation{...} are the two sections.
    """
    bare = re.sub(r"%.*", "", text)
    patterns: dict[str, str] = {}
    exceptions: dict[str, list[int]] = {}
    for section, body in re.findall(r"\\(patterns|hyphenation)\s*\{([^}]*)\}", bare):
        for token in body.split():
            if section == "patterns":
                patterns[re.sub(r"\d", "", token)] = token
            else:
                pieces = token.split("-")
                exceptions["".join(pieces)] = [sum(map(len, pieces[: k + 1])) for k in range(len(pieces) - 1)]
    patterns.pop("", None)
    return patterns, exceptions


def pattern_weights(patterns: Iterable[str]) -> list[tuple[str, int, int]]:
    """(fragment, offset, digit) for every digit of every pattern."""
    out = {}
    for token in patterns:
        letters, votes = "", []
        for c in token:
            if c.isdigit():
                votes.append((len(letters), int(c)))
            else:
                letters += c
        out[letters] = votes
    return [(k, off, w) for k, votes in out.items() for off, w in votes]


def weights_frame(spark: SparkSession, patterns: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(pattern_weights(patterns), WEIGHTS)


def read_tex(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """frag, off, w of a file's patterns, and word, points of its exceptions."""
    text = spark.read.text(path, wholetext=True).first()[0]
    patterns, exceptions = parse_tex(text)
    return weights_frame(spark, patterns.values()), spark.createDataFrame(list(exceptions.items()), "word string, points array<int>")


def tex_lines(weights: DataFrame) -> DataFrame:
    """One pattern a row in TeX form, from frag, off, w."""
    digits = F.map_from_entries(F.collect_list(F.struct("off", "w")))
    rows = weights.groupBy("frag").agg(digits.alias("d"))
    places = F.sequence(F.lit(0), F.length("frag"))
    parts = F.transform(places, lambda i: F.concat(F.coalesce(F.col("d")[i].cast("string"), F.lit("")), F.substring("frag", i + 1, F.lit(1))))
    return rows.select(F.array_join(parts, "").alias("pattern")).orderBy("pattern")


def write_tex(weights: DataFrame, path: str) -> None:
    """An ordered text folder with the \\patterns section; an existing one is an error."""
    body = tex_lines(weights).select(F.col("pattern").alias("value"))
    spark = weights.sparkSession
    head = spark.createDataFrame([("\\patterns{",)], "value string")
    tail = spark.createDataFrame([("}",)], "value string")
    head.union(body).union(tail).coalesce(1).write.mode("errorifexists").text(path)
