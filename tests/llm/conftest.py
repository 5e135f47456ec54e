import pytest

DATA = "/root/testdata/sf0.001"
#: Texts that every operator must take: empty, blank, long, odd white space, ties.
EDGE = [None, "", " ", "\n\n", "word", "a b", "same text here", "same text here", "é日😀 x", "tab\there\r\n", "x" * 70_000, "lang wort " * 20_000, "<|endoftext|> a <s>"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    """Edge texts with a null id, a repeated row and columns whose names clash."""
    rows = [(i, t, "k", 7, 0.5) for i, t in enumerate(EDGE)] + [(None, "null id", None, None, None), (6, "same text here", "k", 7, 0.5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, n_tokens int, score double")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
