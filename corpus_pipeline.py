"""The corpus pipeline: quality rules, near duplicates, repeated strings, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads what it wrote.  All but the last
return the columns of ``documents``.

Defined results: null texts are empty, so the quality rules drop them; rows that share doc_id and text leave one row at
the near duplicates, rows that share a doc_id but not the text are documents of their own; ties go to the smaller
doc_id, null ids last; empty tables give empty results; further columns, whatever their names, stay up to the last
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import bpe, mixing, neardup, quality, repeats, scratch

OWNER = "pipeline"


def _begin(spark: SparkSession) -> None:
    """The stage before has been written, so what it stored for itself can go."""
    scratch.free(spark, OWNER)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their group's fences."""
    _begin(spark)
    packed = docs.select("text", "lang", "source", F.struct(*docs.columns).alias("_row"))
    return quality.judged(packed, OWNER, ("lang", "source", "_row")).filter("kept").select("_row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    _begin(spark)
    return neardup.deduplicated(docs, OWNER)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 50-byte strings that a document with a smaller id has too."""
    _begin(spark)
    return repeats.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for, 0 to 3."""
    _begin(spark)
    return mixing.repeated(docs, OWNER)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    _begin(spark)
    return bpe.digests(docs, bpe.lexicon(docs))


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one_of_each),
    ("repeated strings", cut_repeats),
    ("source mixing", mix),
    ("bpe", encode),
]

#: Sketch fences, sampling and the lexicon have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = scratch.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), f"run of {name}")
    return docs
