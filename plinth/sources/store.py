"""Stored results: per-commit caches, project lists, JSON and CSV inputs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitCache:
    """A table partitioned by commit; only missing commits are computed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder)

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.folder) if self.exists() else None

    def missing(self, commits: DataFrame) -> DataFrame:
        old = self.read()
        return commits if old is None else commits.join(old.select("commit").distinct(), F.col("hash") == F.col("commit"), "left_anti")

    def write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit").parquet(self.folder)

    def size(self) -> int:
        old = self.read()
        return 0 if old is None else old.select("commit").distinct().count()

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents; broken ones are dropped."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(str(path))


def read_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files of a folder with their stem as ``name``."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return spark.read.option("multiLine", True).json(f"{folder}/*.json").withColumn("name", stem)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).schema("name string, variants int, risk_level string, similarity double").csv(str(path))


def load_project(spark: SparkSession, folder: str, project: str) -> DataFrame | None:
    path = Path(folder) / f"{project}.json"
    return read_json(spark, str(path)) if path.exists() else None


def list_projects(spark: SparkSession, folder: str) -> DataFrame:
    return read_json(spark, f"{folder}/*.json", "project_id string, project_path string, status string").where("project_id is not null")
