"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next
stage's documents; what a stage wrote on the way is removed when a later one begins. So a stage's result must be
written before a later stage is called. All but the last return the columns of documents.

Edge cases are those of the operators: NULL and blank texts fail the quality rules, NULL sources and languages
are groups, repeated rows are kept by the rules, lose equal lines alike, count once among near duplicates;
very long texts are worked whole; n_chars follows the text, and columns beside those of documents are dropped.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from larkspur.session import made, remove, written_alone

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*COLUMNS)


# Folders that the stages wrote on the way, by place of the stage.
_LEFT: dict[str, int] = {}


def _stage(place: int) -> Callable:
    """Removes what the stages before ``place`` left, unless the documents still read it."""

    def wrap(make: Callable) -> Callable:
        @wraps(make)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            read = {x.rsplit("/", 1)[0].rsplit("/", 1)[-1] for x in docs.inputFiles()}
            for path in [x for x, at in _LEFT.items() if at < place and x.rsplit("/", 1)[-1] not in read]:
                remove(spark, path)
                del _LEFT[path]
            before = set(made())
            out = make(spark, docs, sf_dir)
            _LEFT.update({x: place for x in made() if x not in before})
            return out

        return run_stage

    return wrap


@_stage(0)
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _shaped(quality_rules.keep_good(docs))


@_stage(1)
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that larger documents hold."""
    return _shaped(line_dedup.dedup_lines(docs))


@_stage(2)
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return _shaped(ngram_join.one_of_each(docs, n=5, percent=80))


@_stage(3)
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document once for each use, in part uses whole."""
    mixed = mixing.mix(docs)
    return _shaped(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "n_copies"))))


@_stage(4)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_duplicates", near), ("source_mix", mixture), ("packing", packed)]

# Robust estimates, hashed sampling keys and tokenization are beyond SQL: tests hold the rows of run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_alone(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
