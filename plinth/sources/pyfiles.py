"""Source trees as tables.

Spark's own file sources skip names that start with ``_`` or ``.``; this one
lists every file that matches, and each partition reads its share of them.

    spark.dataSource.register(PyFiles)
    spark.read.format("pyfiles").option("root", dir).load()

Options: ``root``; ``suffix`` (".py"); ``exclude`` (patterns, one a line) with
``dialect`` glob (path or base name), regex (search in the relative path) or
substring (of the full path); ``partitions`` (8); ``encoding`` ("utf-8",
undecodable bytes replaced).
"""

from __future__ import annotations

import fnmatch
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plinth import schemas


def is_excluded(full: str, relative: str, patterns: list[str], dialect: str) -> bool:
    match dialect:
        case "glob":
            return any(fnmatch.fnmatch(full, p) or fnmatch.fnmatch(os.path.basename(full), p) for p in patterns)
        case "regex":
            return any(re.search(p, relative) for p in patterns)
        case "substring":
            return any(p in full for p in patterns)
    raise ValueError("dialect must be glob, regex or substring")


class Share(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"]
        self.suffix = options.get("suffix", ".py")
        self.patterns = [p for p in options.get("exclude", "").split("\n") if p]
        self.dialect = options.get("dialect", "glob")
        self.n = int(options.get("partitions", "8"))
        self.encoding = options.get("encoding", "utf-8")

    def partitions(self):
        root = Path(self.root)
        if not root.is_dir():
            raise NotADirectoryError(self.root)
        found = sorted(str(p) for p in root.rglob("*" + self.suffix) if p.is_file())
        kept = [p for p in found if not is_excluded(p, os.path.relpath(p, root), self.patterns, self.dialect)]
        return [Share(kept[k :: self.n]) for k in range(min(self.n, max(1, len(kept))))]

    def read(self, partition):
        for p in partition.paths:
            yield os.path.relpath(p, self.root), p, Path(p).read_text(encoding=self.encoding, errors="replace")


class PyFiles(DataSource):
    @classmethod
    def name(cls):
        return "pyfiles"

    def schema(self):
        return schemas.SOURCES

    def reader(self, schema):
        return Reader(dict(self.options))


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, dialect: str = "glob", suffix: str = ".py", partitions: int = 8) -> DataFrame:
    spark.dataSource.register(PyFiles)
    reader = spark.read.format("pyfiles").option("root", str(root)).option("suffix", suffix).option("dialect", dialect).option("partitions", str(partitions))
    return reader.option("exclude", "\n".join(exclude or [])).load()
