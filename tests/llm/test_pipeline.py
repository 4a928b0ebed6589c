"""The pipeline, stage by stage and whole, on a small corpus with known answers."""

import corpus_pipeline
from plinth.llm import queries
from pyspark.sql import functions as F


def corpus():
    p = " ".join(f"p{k}" for k in range(70))
    body = lambda s, n=80: " ".join(f"{s}{k}" for k in range(n))
    rows = [(0, body("a"), "en", "s0"), (1, body("a") + " tail", "en", "s1"), (2, body("b") + " " + p, "en", "s0"), (3, body("c", 200) + " " + p + " end", "de", "s1")]
    rows += [(4, "you idiot , you moron " + body("d"), "en", "s0"), (5, body("e", 5000), None, "s2"), (6, None, None, None), (7, "", "en", "s0"), (8, body("f"), "en", "s1"), (8, body("f"), "en", "s1")]
    return [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows]


def test_stages(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    d = str(tmp_path / "sf")
    spark.createDataFrame(corpus(), schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted(r[0] for r in docs.select("doc_id").collect())
    assert seen["toxicity"] == [0, 1, 2, 3, 5, 6, 7, 8, 8] and seen["ngram-join"] == [0, 2, 3, 5, 6, 7, 8, 8] and seen["suffix-dedup"] == seen["ngram-join"]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert "p3 p4" in text[2] and "p3 p4" not in text[3] and text[3].endswith(" end")
    placed = corpus_pipeline.run(spark, d)
    assert placed.groupBy("group_id", "bin_id").agg(F.sum("n_tokens").alias("n")).where("n > 2048").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram-join", "suffix-dedup", "mixing", "packing"]


def test_one_query_an_operator():
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op"))
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
