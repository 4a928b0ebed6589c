import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{k % 977}" for k in range(30_000))
ODD = [
    (1, "plain words in a short text", "en", "a", 27), (1, "plain words in a short text", "en", "a", 27), (2, "", "en", "a", 0), (3, None, "en", "a", None), (4, "   \n ", None, "b", 5),
    (None, "a row without an id", "de", None, 19), (5, LONG, "fr", "b", len(LONG)), (6, "plain words in a short text", "en", "b", 27), (7, "x", None, None, 1),
]


@pytest.fixture
def odd(spark):
    """Nulls everywhere, an empty, a blank and a very long text, a repeated row, a copy."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    """Extra columns with the names that operators use inside, and a dotted one."""
    from pyspark.sql import functions as F

    names = "_id _text _key _source _tokens _n _p _d _g _lang _group slot shard rule action url_key _cuts _cut_id _gone _w _s hash toxicity".split() + ["a.b"]
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
