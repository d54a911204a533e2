import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, one id twice, and columns whose names operators might use themselves."""
    long = "lorem ipsum dolor sit amet. " * 4000
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (1, "other text of the same id", "y"), (None, "no id here", "x"), (None, None, None),
            (2, None, "x"), (3, "", "y"), (4, "   ", None), (5, long, "hot"), (6, long + "end", "hot"), (7, "word", "hot"), (8, "word", "hot")]
    cols = "doc_id long, text string, source string, size string, k string, th string, n string, node string, h string, score string, copy string"
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], cols)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
