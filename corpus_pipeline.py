"""A corpus pipeline: filter, deduplicate, mix and pack the documents table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.

Nulls, ties, odd input, stage by stage: null and empty texts pass the first three
stages as they are, use no budget in the mix and give no piece; rows with a null
id pass the first two, lose repeated passages like others, are mixed by the hash of
an empty id and packed; repeated rows and rows that share an id stay or go
together; texts of any length are read whole; an empty table gives an empty
result; other columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import mixing, ngram_join, packing, suffix_dedup, toxicity
from plinth.llm._util import ensure_checkpoint_dir
from plinth.llm.queries import MIX_SHARE, SOURCE_WEIGHTS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't rejected for toxicity."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.detector_lexicon(docs, labels), keep="clean")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least id."""
    return ngram_join.keep_one(docs, n=3, threshold=0.5)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that occur earlier."""
    return suffix_dedup.drop_repeats(docs, min_words=50)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, to four fifths of their tokens."""
    return mixing.mixed_documents(docs, SOURCE_WEIGHTS, share=MIX_SHARE)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placement of each document's tokens in bins of 2,048."""
    return packing.pack(docs, capacity=2048, group_size=8192)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram-join", drop_similar),
    ("suffix-dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: Automata, the approximate join, the suffix array and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents table."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        written = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before:  # of the stages only the last is kept, which the result reads
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = written
    return docs
