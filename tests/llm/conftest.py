import pytest
from edge_cases import EDGES


@pytest.fixture(scope="session")
def rows_of(spark):
    """A DataFrame of documents with columns whose names operators use inside."""

    def make(rows, extra=True):
        schema = "doc_id bigint, text string, source string, n_chars bigint" + (", size int, row int, print string, key string" if extra else "")
        full = [(i, t, s, None if t is None else len(t)) + ((7, 8, "p", "k") if extra else ()) for i, t, s in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def edges(rows_of):
    return rows_of(EDGES)


@pytest.fixture(scope="session")
def nothing(rows_of):
    return rows_of([])
