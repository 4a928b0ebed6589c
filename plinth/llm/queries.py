"""One query an operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import hmm, media, mixing, ngram_join, packing, quality, sharding, suffix_dedup, toxicity, url_filter

SHARDS = {f"shard-{k:03d}": 1 + (k % 4 == 0) for k in range(96)}
SOURCE_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
MIX_SHARE = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), SHARDS)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, to four fifths of their tokens."""
    return mixing.mix(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, share=MIX_SHARE)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that occurs more than once."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), min_words=50)


def op4_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and numbers of links of documents with a 3-gram Jaccard similarity of at least 0.5."""
    return ngram_join.links(table(spark, sf_dir, "documents"), n=3, threshold=0.5)


def rendered_images(embeddings: DataFrame) -> DataFrame:
    """A media column for the embeddings table: a picture drawn from each vector;
    ids that leave 3 or 7 on division by 8 show an edited copy of the one before."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    before = embeddings.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    shown = embeddings.select("vec_id", "embedding").join(before, "vec_id", "left")

    def render(batches):
        for batch in batches:
            images = []
            for k, v, old in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), batch.column("before").to_pylist(), strict=True):
                copy = k is not None and k % 4 == 3 and old is not None
                picture = media.draw(np.array(old if copy else v or [0.0]))
                images.append(media.pgm(media.edited(picture, k // 4 % 4) if copy else picture))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(images, pa.binary())], names=["vec_id", "image"])

    return shown.mapInArrow(render, f"vec_id {kind}, image binary")


def op5_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cropped, dimmed, turned and shrunk copies among the pictures of the embeddings."""
    return media.find_copies(rendered_images(table(spark, sf_dir, "embeddings")), id_col="vec_id")


def op6_toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rejected for toxicity, with their scores."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.detector_lexicon(docs, labels))


HOST = r"^[A-Za-z]+://([^/?#:]+)"


def url_rules(pages: DataFrame) -> DataFrame:
    """Rules from the pages' own hosts: each domain is allowed, a spam or pills
    host blocked, German sections reviewed; nested three deep."""
    found = pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("h"), F.regexp_extract("url", HOST + "(/[^/?#]+/)", 2).alias("section")).where("h <> ''").distinct()
    action = F.when(F.col("h").rlike("spam|pills"), F.lit("block")).otherwise(F.lit("allow"))
    domains = found.select(F.concat_ws(".", F.slice(F.split("h", r"\."), -2, 2)).alias("rule"), F.lit("allow").alias("action"))
    hosts = found.select(F.col("h").alias("rule"), action.alias("action"))
    sections = found.where("section = '/de/'").select(F.concat("h", "section").alias("rule"), F.lit("review").alias("action"))
    return domains.union(hosts).union(sections).distinct()


def op7_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deciding rule of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.apply(pages, url_rules(pages))


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of every document's tokens in bins of 2,048."""
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048, group_size=8192)


def op9_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust distance of every document from its language and source."""
    return quality.outliers(table(spark, sf_dir, "documents"))


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every document under a model trained on all of them."""
    return hmm.score(table(spark, sf_dir, "documents"), states=6, rounds=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_placement": op1_shard_placement,
    "op2_mix_sources": op2_mix_sources,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_similar_pairs": op4_similar_pairs,
    "op5_media_copies": op5_media_copies,
    "op6_toxic_documents": op6_toxic_documents,
    "op7_filter_urls": op7_filter_urls,
    "op8_pack_documents": op8_pack_documents,
    "op9_quality_outliers": op9_quality_outliers,
    "op10_hmm_scores": op10_hmm_scores,
}

TOKENS_SQL = r"coalesce(len(regexp_extract_all(text, '\S+')), 0)"

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": f"""
WITH k AS (SELECT doc_id, source, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS key, {TOKENS_SQL} AS n_tokens,
             CASE source WHEN 'src0' THEN 4.0::DOUBLE WHEN 'src1' THEN 2.0::DOUBLE WHEN 'src2' THEN 2.0::DOUBLE WHEN 'src3' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w
           FROM documents),
v AS (SELECT doc_id, source, n_tokens, (sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / w AS virtual_finish FROM k),
r AS (SELECT *, sum(n_tokens) OVER (ORDER BY virtual_finish RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM v),
e AS (SELECT min(virtual_finish) AS cut FROM r WHERE run > (SELECT CAST(floor(0.8::DOUBLE * sum(n_tokens)) AS BIGINT) FROM k))
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, virtual_finish FROM v WHERE coalesce(virtual_finish < (SELECT cut FROM e), true)
""",
    "op7_filter_urls": r"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#:]+(/[^/?#]+/)', 1) AS section,
             regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^?#]*)', 1) AS path, regexp_extract(url, '(\?[^#]*)', 1) AS query FROM pages),
k AS (SELECT *, array_to_string(list_reverse(string_split(h, '.')), '.') || '.' || CASE WHEN path = '' THEN '/' ELSE path END || query AS url_key FROM u),
r AS (SELECT DISTINCT array_to_string(string_split(h, '.')[-2:], '.') AS rule, 'allow' AS action FROM u
      UNION SELECT h, CASE WHEN regexp_matches(h, 'spam|pills') THEN 'block' ELSE 'allow' END FROM u
      UNION SELECT h || section, 'review' FROM u WHERE section = '/de/'),
rk AS (SELECT rule, action, array_to_string(list_reverse(string_split(split_part(rule, '/', 1), '.')), '.') || '.' || CASE WHEN rule LIKE '%/%' THEN '/' || split_part(rule, '/', 2) || '/' ELSE '' END AS prefix FROM r),
m AS (SELECT k.page_id, k.url, k.url_key, rk.rule, rk.action, row_number() OVER (PARTITION BY k.page_id ORDER BY length(prefix) DESC, rk.action, rk.rule) AS n
      FROM k LEFT JOIN rk ON starts_with(k.url_key, rk.prefix))
SELECT page_id, url, url_key, rule, coalesce(action, 'allow') AS action FROM m WHERE n = 1
""",
}
