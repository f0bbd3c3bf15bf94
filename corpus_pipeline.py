"""Cleans the documents and packs them; each stage calls one operator of ``meguri.llm``.

Every stage but the last returns the columns of ``documents``; each is written
as Parquet to the shared folder and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meguri.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from meguri.llm.common import step, table


def _plain(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """(docs, its columns but doc_id), where all but doc_id and text have names that no operator uses."""
    names = [c if c in ("doc_id", "text") else f"_column_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), tuple(n for n in names if n != "doc_id")


def _named(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, from what ``_plain`` made of them."""
    return kept.select(*_plain(docs)[0].columns).toDF(*docs.columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on what ``labels`` has of them, does not reject."""
    rows, others = _plain(docs)
    model = toxicity.fit(rows, table(spark, sf_dir, "labels"))
    return _named(toxicity.score(rows, model, others).filter(~F.col("rejected")), docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each near-duplicate line once; documents left without any of their words go."""
    return line_dedup.deduplicated(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    rows, others = _plain(docs)
    found = decontaminate.find(rows, table(spark, sf_dir, "benchmark"), carry=others)
    return _named(decontaminate.with_verdict(found).filter(~F.col("contaminated")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of the permitted lengths."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: No SQL: models are fitted and signatures are hashed; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = step(docs, name.replace(" ", "-"))
    return docs
