"""Git repositories as tables, without touching their work tree.

``commits``: newest first; a commit's files and lines are those against its
first parent, renames as ``old -> new``; the root commit has none.
``snapshot_files``: the files of each commit as blob ids; ``blobs``: the text of
each distinct blob, so that a file that many commits share is read once.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plinth import schemas

FORMAT = "%x01%H%x00%ct%x00%an%x00%ae%x00%P%x00%B%x02"


def git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], input=data, capture_output=True)
    if done.returncode:
        raise RuntimeError(done.stderr.decode(errors="replace").strip())
    return done.stdout


def commit_rows(repo: str, branch: str, most: int) -> Iterator[tuple]:
    import datetime as dt

    args = ["log", "--no-color", "-M", "--numstat", "-z", "--diff-merges=first-parent", "--no-show-signature", f"--format={FORMAT}"]
    raw = git(repo, *args, *(["-n", str(most)] if most > 0 else []), branch, "--").decode(errors="replace")
    for k, part in enumerate(raw.split("\x01")[1:]):
        head, _, stats = part.partition("\x02")
        h, when, author, email, parents, message = head.split("\x00", 5)
        files, added, removed = [], 0, 0
        fields = [f for f in stats.strip("\n").split("\x00")]
        i = 0
        while parents and i < len(fields):
            cells = fields[i].lstrip("\n").split("\t")
            if len(cells) == 3:
                if cells[2]:
                    files.append(cells[2])
                    i += 1
                else:  # a rename: both names follow
                    files.append(f"{fields[i + 1]} -> {fields[i + 2]}")
                    i += 3
                added += int(cells[0]) if cells[0].isdigit() else 0
                removed += int(cells[1]) if cells[1].isdigit() else 0
            else:
                i += 1
        time = dt.datetime.fromtimestamp(int(when), dt.timezone.utc)
        yield k, h, h[:7], time, author, email, message.strip(), files, added, removed


class History(InputPartition):
    def __init__(self):
        pass


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo, self.branch, self.most = options["repo"], options.get("branch", "HEAD"), int(options.get("max_commits", "0"))

    def partitions(self):
        return [History()]

    def read(self, partition):
        yield from commit_rows(self.repo, self.branch, self.most)


class GitLog(DataSource):
    """Options: ``repo``, ``branch`` ("HEAD"), ``max_commits`` (0: all)."""

    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return schemas.COMMITS

    def reader(self, schema):
        return Reader(dict(self.options))


def commits(spark: SparkSession, repo: str, branch: str = "HEAD", max_commits: int = 0) -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("gitlog").option("repo", str(repo)).option("branch", branch).option("max_commits", str(max_commits)).load()


def snapshot_files(chosen: DataFrame, repo: str, suffix: str = ".py") -> DataFrame:
    """``commit, path, blob`` of all files of each commit in ``chosen(hash)``."""
    repo = str(repo)

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h in batch.column("hash").to_pylist():
                rows = []
                for entry in git(repo, "ls-tree", "-r", "-z", h).decode(errors="replace").split("\0"):
                    meta, _, path = entry.partition("\t")
                    if path.endswith(suffix) and " blob " in meta:
                        rows.append({"commit": h, "path": path, "blob": meta.split()[2]})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("commit", pa.string()), ("path", pa.string()), ("blob", pa.string())]))

    return chosen.select("hash").mapInArrow(listing, schemas.SNAPSHOT_FILES)


def blobs(files: DataFrame, repo: str) -> DataFrame:
    """``path, content`` with the blob id as path, one row a distinct blob."""
    repo = str(repo)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("blob").to_pylist()
            raw, at, texts = git(repo, "cat-file", "--batch", data="".join(f"{b}\n" for b in ids).encode()), 0, []
            for _ in ids:
                end = raw.index(b"\n", at)
                n = int(raw[at:end].split()[2])
                texts.append(raw[end + 1 : end + 1 + n].decode(errors="replace"))
                at = end + 2 + n
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])

    return files.select("blob").distinct().mapInArrow(read, "path string, content string")


def state(spark: SparkSession, repo: str) -> DataFrame:
    """One row: branch ("HEAD" when detached), head commit, dirty flag, remote URL or null."""
    repo = str(repo)
    branch, head = git(repo, "rev-parse", "--abbrev-ref", "HEAD").decode().strip(), git(repo, "rev-parse", "HEAD").decode().strip()
    dirty = bool(git(repo, "status", "--porcelain", "--untracked-files=no").strip())
    names = git(repo, "remote").decode().split()
    url = git(repo, "remote", "get-url", "origin" if "origin" in names else names[0]).decode().strip() if names else None
    return spark.createDataFrame([(branch, head, dirty, url)], "branch string, head string, is_dirty boolean, remote_url string")


def analyze_at(spark: SparkSession, repo: str, commit: str, analyze=None) -> DataFrame:
    """``analyze`` (default: none) applied to ``path, content`` of one commit."""
    one = spark.createDataFrame([(git(str(repo), "rev-parse", commit).decode().strip(),)], "hash string")
    files = snapshot_files(one, repo)
    texts = files.join(blobs(files, repo).select(F.col("path").alias("blob"), "content"), "blob").select("path", "content")
    return analyze(texts) if analyze else texts
