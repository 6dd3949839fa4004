import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """documents-shaped table from (doc_id, text) rows, with extra columns whose names clash with internal ones."""

    def build(rows, extra=True):
        df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            for name in ("key", "score", "piece", "n", "a", "count", "Kept"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build


@pytest.fixture
def empty(make):
    return make([])


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "two WORDS"), (7, "ÄÖ Ü é"), (8, "a " * 3000),
       (9, "x" * 5000), (10, "one"), (10, "one"), (None, "null id"), (12, "emoji 😀 ▁ and \x00 zero")]


@pytest.fixture
def odd(make):
    return make(ODD)
