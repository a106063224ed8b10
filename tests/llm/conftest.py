import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows and ids, and clashing columns."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    rows = [
        (1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t", "en", None, 3), (None, "a b c d e f g", "en", "s", 13),
        (5, long, "de", "t", len(long)), (6, "one", "en", "s", 3), (6, "other text under the same id", "en", "s", 28), (7, "ü Ö ß 日本語 🙂́", "fr", "s", 12),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for clash in ("id", "key", "rep", "f0", "n", "a", "b", "__th", "doc", "score", "keep", "epoch", "bucket", "tokens", "removed_lines", "ids", "decoded", "component_id", "fingerprint"):
        df = df.selectExpr("*", f"'clash' as `{clash}`")
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
