"""Documents with every awkward case: nulls, empty, very long, repeated rows, copies, and columns of clashing names."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own columns
        T.StructField("n_words", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("copies", T.StringType()),
        T.StructField("host", T.StringType()),
    ]
)


def make_rows() -> list[tuple]:
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and", "Äpfel", "naïve", "中文"]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    passage = prose(40)
    texts = [prose(rnd.randint(60, 160)) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1] + " end", texts[2].replace(" the ", " THE\t\n ")]  # copies
    texts += [prose(30) + " " + passage + " " + prose(30) for _ in range(8)]  # one passage in many
    texts += ["a " * 70, "x", "", None, "  \n\t ", "one two", " ".join(["again and again"] * 30), prose(6000)]
    texts += ["# $ % & | < >\n" * 12 + prose(60), "same line here\n" * 9 + prose(70), "no break   space"]
    rows = []
    for i, text in enumerate(texts):
        source = None if i % 11 == 3 else ("big" if i % 3 == 0 else f"s{i % 4}")
        rows.append((i * 3, text, "en", source, len(text or ""), "clash", -1, "clash", "clash", "clash", "clash"))
    rows += [rows[4], rows[4], rows[-5]]  # repeated rows
    rows.append((None, texts[5], "en", "s1", 3, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
