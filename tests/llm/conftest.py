import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, `key` string, run int, "
          "`row` int, n int, size int, component long, worker int, `_stays` int, best int, `__text_key` int")
LONG = "lorem ipsum dolor sit amet consectetur " * 4000


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls in both, empty and blank texts, ties, a repeated row, a very long text."""
    return [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"),
            (3, None), (4, ""), (5, " \t\n "), (6, LONG), (7, LONG + "end"),
            (None, "alpha beta gamma delta epsilon zeta"), (None, None), (8, "Ünïcode ΣΑΣ 日本 🎉"),
            (9, "short"), (9, "short"), (1 << 40, "x")]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The edge rows with extra columns whose names clash with internal ones, some null."""
    return spark.createDataFrame([(i, t, None, "s", None, 0, "k", 1, 2, 3, 4, 5, 6, 7, None, 8)
                                  for i, t in edge_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false").coalesce(1)
