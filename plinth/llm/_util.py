"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: ``spark.checkpoint.dir``, or, where that is
    unset and the master is local (tests), a temporary folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plinth-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet (names clash without regard to case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str):
    """Column by exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str):
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def map_rows(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` for any column names: ``fn`` sees the columns as c0, c1, ..."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(fn, schema)
