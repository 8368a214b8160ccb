import pytest


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from storkline.session import build_session

    folder = tmp_path_factory.mktemp("stages")
    session = build_session(
        "llm-tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                        "spark.driver.memory": "4g", "spark.checkpoint.dir": str(folder)}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text) of the shared small table."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(table["doc_id"], table["text"], strict=True))


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, value long, rep long, label string, id long, n long, kept string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and columns named like inner ones."""
    long_text = "word " * 60_000 + "x" * 100_000
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 4), (4, "one", "en", None, 3),
        (5, "one two three four five six", "en", "b", 27), (6, "One Two three four five six", None, None, None),
        (6, "One Two three four five six", None, None, None), (7, long_text, "de", "b", len(long_text)),
        (None, "one two three four five six", "en", "b", 27), (None, None, None, None, None), (9, "ünï 　 çode ÀÉ 😀 text", "fr", "b", 20),
    ]
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, "y") for r in rows], CLASHING)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASHING)
