import re
import zlib

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, score double, cid long, kept boolean, evidence string"


def words(text, lower=False):
    return WORD.findall((text or "").translate(AZ) if lower else text or "")


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows; further columns with names that operators use."""
    text = "one two three four five six seven eight nine ten " * 12
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, text, "en", "a"), (4, text, "en", "a"), (None, text, "en", None),
        (None, None, None, None), (5, "x" * 70_000, "de", "b"), (6, "wort ist gut " * 30_000, "de", "b"), (7, text + "tail", "en", "c"), (8, "Zoë's café \U0001f600 <|endoftext|> it's\n\n  12'd", "fr", "b"),
        (9, "one two", "fr", "b"), (10, "one TWO", "fr", "c"), (11, "\n".join(["you are an idiot"] * 40), "en", "c"), (12, "***", None, "c"),
    ]
    return [(*r, 0, 1, 2, 0.5, 3, True, "e") for r in rows]


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 0, 1), (11, 0, 1), (None, 0, 1), (7, None, None), (9, 7, 7)], "doc_id long, quality int, toxic int")
