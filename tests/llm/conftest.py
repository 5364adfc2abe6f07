import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return docs.orderBy("doc_id").collect()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, extra columns with clashing names."""
    texts = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (None, "a b c d e"), (3, ""), (4, " \t\n "), (5, "A B c d e"),
             (6, "wörter und 日本語 mix"), (7, "long " * 20_000), (None, None), (8, "x" * 50_000)]
    cols = "doc_id long, text string, lang string, source string, n_chars long, id long, label int, shard int, size int, _c0 int, _next string"
    return spark.createDataFrame([(i, t, None, None if k % 3 else "s", None, 1, 2, 3, 4, 5, "n") for k, (i, t) in enumerate(texts)], cols)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
