"""From raw documents to packed training sequences, in five stages over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontam, exact, minhash, packing, toxicity
from graphloom.llm.common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, in docs' columns.

    Null and empty texts are scored too, repeated rows alike, no rows give none; without labels nothing is rejected.
    Columns of any name stay.
    """
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, in docs' columns.

    Null texts count as empty; of ties the smallest id stays, null ids last; of rows repeated whole one stays; no rows
    give none. Columns of any name stay.
    """
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, as op1 has them: two-word shingles at similarity 0.8.

    Null and empty texts are near nothing; the smallest id of a component stays; of rows repeated whole one stays; no rows
    give none. Columns of any name stay.
    """
    return minhash.drop_near_duplicates(docs, shingle_words=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much text of the benchmark, in docs' columns.

    Null and empty texts are clean, repeated rows are judged alike, no rows give none, an empty benchmark takes nothing.
    Columns of any name stay.
    """
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the remaining documents with its place in a sequence.

    Null texts count as empty, and an empty text is the end id alone; each repeated row is packed; no rows give none;
    further columns are left out.
    """
    return packing.pack(docs, packing.public_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL has neither the toxicity model nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each on a written table of what the one before it kept."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
