import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table like ``documents`` from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


#: Empty, missing, long, repeated and tied rows: what every operator has to take.
AWKWARD = ((1, None), (2, ""), (3, " \t\n"), (4, "word"), (4, "word"), (5, "word"), (6, "long text " * 20_000), (7, "é" * 300), (None, "nobody"))


@pytest.fixture
def awkward(documents):
    return documents(*AWKWARD)


@pytest.fixture
def clashing():
    """Adds columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("fp", "key", "label", "digest", "points", "kept", "n", "line", "pos", "score", "id", "x", "token", "rank", "row", "component_id", "keep_id", "words", "tokens", "p", "rate", "y", "media", "spans")
    return lambda df: df.withColumns({c: F.lit("clash") for c in names if c not in df.columns})
