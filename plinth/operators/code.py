"""From source texts to code relations: files, definitions, blocks, variables.

Parsing is the one step in Python, in Arrow batches; a file that can't be parsed
gives a row with ``parse_error`` (files) or none (blocks, variables).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructType

from plinth import schemas
from plinth.functions import scalar
from plinth.operators import relational
from plinth.parse import inspector, normalize
from plinth.parse import variables as names


def _rows(df: DataFrame, schema: str, fn: Callable[[str, str], list[dict]]) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                out += fn(path, content or "")
            yield pa.RecordBatch.from_pylist([{f.name: _plain(r.get(f.name)) for f in arrow} for r in out], schema=arrow)

    return df.select("path", "content").mapInArrow(run, schema)


def _plain(value):
    return list(value.items()) if isinstance(value, dict) and not {"risk_flag"} & set(value) else value


def files(sources: DataFrame) -> DataFrame:
    """One row a file of ``path, content``."""

    def one(path: str, content: str) -> list[dict]:
        try:
            return [{"path": path, **inspector.inspect_source(content), "parse_error": None}]
        except (SyntaxError, ValueError, RecursionError) as err:
            return [{"path": path, "parse_error": f"{type(err).__name__}: {err}"}]

    return _rows(sources, schemas.FILES, one)


def parsed(files_: DataFrame) -> DataFrame:
    return files_.where("parse_error is null")


def definitions(files_: DataFrame) -> DataFrame:
    """One row a definition, ``ordinal`` counting within its file."""
    return parsed(files_).select("path", F.posexplode("definitions").alias("ordinal", "d")).select("path", "ordinal", "d.*")


def import_edges(files_: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` of files that import files of the project, by absolute dotted name."""
    wanted = parsed(files_).select(F.col("path").alias("src"), F.explode("imports").alias("m")).select("src", scalar.module_path("m").alias("dst"))
    known = files_.select(F.col("path").alias("dst")).distinct()
    return wanted.join(known, "dst", "left_semi").select("src", "dst").distinct()


def internal_imports(files_: DataFrame) -> DataFrame:
    return import_edges(files_).groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("internal_imports"))


@F.udf(ArrayType(StringType()), useArrow=True)
def diff_lines(base, other):
    return normalize.unified_diff(base, other)


def name_variants(defs: DataFrame) -> DataFrame:
    """Names with several implementations, each with the diff from the first one."""
    keyed = defs.withColumn("_o", F.struct("path", "ordinal"))
    found = relational.name_variants(keyed, "name", "source_hash", "path", "_o").drop("first_seen")
    texts = defs.groupBy("source_hash").agg(F.first("source_text").alias("source_text"))
    base = texts.select(F.col("source_hash").alias("base_hash"), F.col("source_text").alias("base_text"))
    joined = found.join(texts, "source_hash").join(base, "base_hash")
    diff = F.when(F.col("is_base"), F.array().cast("array<string>")).otherwise(diff_lines("base_text", "source_text"))
    return joined.select("name", "position", "source_hash", "path", "is_base", "n_implementations", diff.alias("diff_from_base"), scalar.refactor_prompt("name").alias("refactor_prompt"))


def call_edges(defs: DataFrame) -> DataFrame:
    """Distinct ``src, dst``: definitions and the simple names that they call."""
    return defs.select(F.col("name").alias("src"), F.explode("outbound_calls").alias("dst")).where("src <> dst or dst is not null").distinct()


def project_call_edges(defs: DataFrame) -> DataFrame:
    """Call edges between the project's own definitions (methods by their last name)."""
    own = defs.where("category <> 'method'").select(F.col("name").alias("dst")).distinct()
    callers = defs.where("category <> 'method'")
    return call_edges(callers).join(own, "dst", "left_semi").select("src", "dst")


def uncalled(defs: DataFrame) -> DataFrame:
    """Functions and classes that nothing in the project calls; names with a leading underscore don't count."""
    called = call_edges(defs).select(F.col("dst").alias("name")).distinct()
    return defs.where("category <> 'method'").where(~F.col("name").startswith("_")).join(called, "name", "left_anti")


def class_edges(defs: DataFrame) -> DataFrame:
    return defs.where("category = 'class'").select(F.explode("parents").alias("src"), F.col("name").alias("dst")).distinct()


def variables(sources: DataFrame, compat: bool = False) -> DataFrame:
    """Definitions and usages of names, tagged by ``is_definition``."""

    def one(path: str, content: str) -> list[dict]:
        try:
            return [{"path": path, **r} for r in names.variable_rows(content, compat)]
        except (SyntaxError, ValueError, RecursionError):
            return []

    return _rows(sources, schemas.VARIABLES, one)


def variable_flows(v: DataFrame) -> DataFrame:
    """One row a name: counts, places, redefined, orphan (defined, not private, never used), undefined."""
    flows = relational.flow_counts(v.where("is_definition"), v.where("not is_definition"), "name")
    place = F.struct("path", "line_number", "scope", "kind")
    places = v.groupBy("name").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_definition"), place))).alias("definitions"), F.array_sort(F.collect_list(F.when(~F.col("is_definition"), place))).alias("usages")
    )
    return flows.join(places, "name").withColumn("is_orphan", F.col("is_orphan") & ~F.col("name").startswith("_"))


def variable_report(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count("*").alias("total_count"), F.count_if("is_orphan").alias("orphaned_count"), F.count_if("is_undefined").alias("undefined_count"))


@F.udf(ArrayType(StringType()), useArrow=True)
def mentioned(expression):
    return names.names_in(expression)


def variable_dependencies(v: DataFrame) -> DataFrame:
    """Distinct ``src, dst``: a name and the names its assigned values mention."""
    valued = v.where("is_definition and value_source is not null and kind = 'assignment'")
    return valued.select(F.col("name").alias("src"), F.explode(mentioned("value_source")).alias("dst")).distinct()


def variable_users(v: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct ``src, dst``: functions among ``nodes(name)`` and the variables they use."""
    used = v.where("not is_definition and scope like 'function:%'").select(F.substring_index("scope", ":", -1).alias("src"), F.col("name").alias("dst"))
    defined = v.where("is_definition").select(F.col("name").alias("dst")).distinct()
    return used.join(nodes.select(F.col("name").alias("src")).distinct(), "src", "left_semi").join(defined, "dst", "left_semi").select("src", "dst").distinct()


def blocks(sources: DataFrame, min_lines: int = 5, embed: Callable[[str], list[float]] | None = None) -> DataFrame:
    """Functions and classes of at least ``min_lines`` lines with hash, normal form
    and embeddings of both texts (token counts unless ``embed`` is given)."""
    embedder = embed or normalize.token_vector

    def one(path: str, content: str) -> list[dict]:
        try:
            found = normalize.code_blocks(content, min_lines)
        except (SyntaxError, ValueError, RecursionError):
            return []
        for b in found:
            normal = normalize.normalize(b["content"])
            digest = hashlib.sha256(b["content"].encode("utf-8", "surrogatepass")).hexdigest()
            b |= {"path": path, "hash": digest, "normalized": normal, "embedding": embedder(b["content"]), "embedding_normalized": embedder(normal)}
        return found

    found = _rows(sources, schemas.BLOCKS, one)
    return relational.numbered(found, "path", "ordinal", name="block_id", start=0)


def code_sequence(order: DataFrame) -> DataFrame:
    return order.withColumn("next", F.lead("node").over(Window.orderBy("position")))
