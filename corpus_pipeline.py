"""A training corpus from documents in five stages, each one operator of ``fluorite.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of ``docs`` with their types, whatever else these are named. A null text counts as empty, repeated rows are rows each, and
rows with a null doc_id, to which no result can refer, are never taken for copies or leaks. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluorite.llm import decontam, minhash, packing, quality, secrets
from fluorite.llm.common import stage, table

#: Ids of dropped documents are broadcast up to so many, 8 bytes each; beyond that they are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000

#: Word shingles of five and a similarity of 0.8.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
QUALITY_THRESHOLD = 0.3


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (one column, doc_id)."""
    ids = stage(ids.distinct())
    return docs.join(F.broadcast(ids) if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS else ids, "doc_id", "left_anti")


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer until no column of ``docs`` has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels`` of these documents, scores 0.3 or more."""
    model, into = quality.train(docs, table(spark, sf_dir, "labels")), _free(docs, "quality_score")
    return quality.score(docs, model, into).where(F.col(into) >= QUALITY_THRESHOLD).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; all rows of that id stay."""
    found = minhash.near_duplicates(docs, words=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)
    return _without(docs, found.where(~F.col("kept")).select("doc_id")).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``; of an id with one, no row stays."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("doc_id IS NOT NULL").select("doc_id")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values that look live or shared replaced in their texts; n_chars, where it is, follows the text."""
    into = _free(docs, "secrets")
    found = secrets.scan(docs, into=into).withColumn("text", secrets.redact(F.col("text"), F.col(into)))
    if "n_chars" not in docs.columns:
        return found.select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in full sequences, by shares of the sources."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The first stage scores with a trained model, which SQL can't express; the tests compare each stage with its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
