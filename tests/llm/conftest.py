import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of texts, doc ids from 0; more columns whose names clash with those that operators use."""

    def make(texts, clash=False):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)
        if clash:
            for name in ("node", "component", "length", "held_out", "score", "spans", "chunk", "n", "ids", "media"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df.repartition(3)

    return make


@pytest.fixture(scope="session")
def words():
    """Invented prose by a seed."""
    import random

    def make(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(["ka", "lo", "mi", "ru", "ten", "sa", "vo"]) for _ in range(r.randint(2, 5))) for _ in range(n))

    return make
