"""Rows that every operator has to stand: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} stays {i}" for i in range(60_000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t \n", "en", "a", 5),
    (None, "a text whose row has no id but a phone +1 202 555 0143", None, None, None),
    (4, LONG, "en", "b", len(LONG)),
    (5, "the same row stands here twice and so it does", "en", "a", 45),
    (5, "the same row stands here twice and so it does", "en", "a", 45),
    (6, "Ünïcödé 漢字 🙂 ça va؟   nbsp", "fr", "b", 30),
    (7, "x" * 50_000, "en", None, 50_000),
    (8, "> quoted\n>> twice\nplain <b>tag</b> & 1.2.3.4 mail@post.example", "de", "c", 60),
]
CLASHES = ("score", "label", "size", "rank", "salt", "length", "start", "kept", "n_words", "_text", "band", "group", "copy", "held_out", "target", "node", "_copy", "_times", "_id", "_doc", "document", "times", "row", "text_hash", "order_hash", "nth", "shard", "failed")


def edge(spark: SparkSession) -> DataFrame:
    """The rows above, with further columns named like what operators use inside."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def empty(spark: SparkSession) -> DataFrame:
    return edge(spark).limit(0)
