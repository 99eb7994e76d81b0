"""From documents to packed training bins: quality, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents, whatever further ones there are.
Between stages the rows are written as Parquet to the shared folder and read again.
The order of rows counts from the mixing on: the packing reads it from the written table.

A row is known by its doc_id and its text: rows that share an id but not the text are
documents of their own in every stage, and a repeated row goes with the near duplicates.
Rows without an id are kept like others and come last where ids are compared. Null and
empty texts pass every stage (quality scores them as empty texts) unless they are
repeated rows; the packing gives them places of length 0. A very long text is handled
whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import jaccard, mixing, packing, quality, scratch, substr


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't reject (score 0.3 or more). Without a positive label there is nothing to learn from and nothing is rejected."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, 0.3, keep_columns=True) if model is not None else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the n-gram Jaccard join one row, that of the least id. A row is known by id and text: another text under the same id stays, a repeated row goes."""
    return jaccard.kept_rows(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the passages that an earlier document keeps; a text that is left empty by it goes."""
    return substr.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the Pfair schedule."""
    return mixing.mixed(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each text goes: doc_id, source, piece, start, length, bin_id, bin_offset. Bins in ascending order follow the order of the rows, that is the mix, shard by shard."""
    return packing.pack(scratch.placed(docs, "__at"), order="__at")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: The classifier, content-cut paragraphs and best fit have no SQL form; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
