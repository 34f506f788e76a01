"""Corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again before the next stage. All but the last return the
columns of their input, further ones included, whatever their names, and give no rows
for an empty table. Ids may repeat or be null; texts may be null, empty or of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common, jaccard, mixing, packing, pii, rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the threshold table rejects.

    Null, empty and short texts are rejected; repeated rows are judged alike and stay repeated.
    """
    return rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class: the one with the lowest id, null ids last.

    Rows that repeat an id and a text count as copies; rows that share an id only are
    told apart by their text. Null texts and texts without words all stay.
    """
    return jaccard.distinct_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the new text.

    Null texts stay null, with a null n_chars; equal texts change alike.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it.

    Null and empty texts have no words, so they go; rows that repeat an id and a text are taken alike.
    """
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 2048 tokens.

    A null or empty text is its end token; repeated rows are separate documents; only doc_id and text are read.
    """
    pieces = packing.pack_documents(docs, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Hash-seeded mixing, the network and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. The working tables of a stage go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with common.scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
