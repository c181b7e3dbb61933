"""Raw documents to packed token sequences, in five stages.

Every stage takes what the one before kept, as a written table, and returns the columns of documents;
the last returns the pieces of packed sequences with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import decontaminate, language_id, minhash, packing, toxicity
from rookery.llm.staging import stage

#: A text whose likeliest language has less than this mean probability is in none of the languages.
LEAST_LANGUAGE = 0.4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts in none of the languages learned from the labelled ones."""
    found = language_id.identify(docs, language_id.fit(docs))
    pred, score = found.columns[-2:]
    return found.where((F.col(pred) != language_id.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE)).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the classifier predicts to be toxic."""
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.where(F.col(scored.columns[-1]) == 0).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates (5 words, 0.8)."""
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of which one word in twenty or more lies in benchmark windows."""
    judged = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col(judged.columns[-1])).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained classifiers and signatures have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
