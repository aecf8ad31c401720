"""Corpus pipeline: quality, language, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result as Parquet in the shared checkpoint folder and reads it
back as the next stage's ``docs``.  All but the last return the columns of
``documents``.  Every stage works on all that its predecessor kept.  The
classifiers decide row by row.  The deduplication stages number the rows and
keep exactly one row of each group, that with the smallest doc_id (nulls last),
then the smallest number; rows that share a doc_id or have none are told apart.

Edge cases: null and empty texts are scored like any other and are ``und``, so the
language filter drops them; very long texts are read whole by every stage; an
empty table gives an empty result with the same columns; extra columns pass
through all stages but the last.

``ORACLE_SQL`` is None: SQL expresses neither classifier.  The tests compare
the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import exact_dedup, langid, packing, quality, simhash
from tarmac.llm.common import materialize, read_table, ship_package
from tarmac.llm.queries import language_held_out, quality_held_out

ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~quality_held_out())
    return docs.filter(quality.scorer(spark, model)(F.col("text")) >= quality.THRESHOLD)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language."""
    found = langid.predictor(spark, langid.fit(docs, ~language_held_out()))(F.col("text"))
    return docs.filter(found["lang_pred"] != langid.UNDETERMINED)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a number per row, and the name of that column."""
    key = "row_key"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def _only_kept(rows: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """The numbered ``rows`` less those that ``groups`` does not keep."""
    dropped = materialize(groups.filter(~F.col("kept")).select(F.col("row_key").alias(key)), "drop")
    return rows.join(dropped, key, "left_anti").drop(key)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group with equal text."""
    rows, key = _numbered(docs)
    return _only_kept(rows, key, exact_dedup.exact_groups(rows, key_col=key))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, the first one with the smallest doc_id, of each SimHash group."""
    rows, key = _numbered(docs)
    return _only_kept(rows, key, simhash.near_duplicate_groups(rows, shingle_words=3, max_bits=3, key_col=key))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("language ID", language_filter),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, the last stage's rows."""
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
