import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomtrace.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events_of(spark):
    """Event rows from dicts, with every canonical column."""
    from loomtrace.operators.columns import EVENT_COLUMNS

    def make(rows, session="session-1"):
        schema = ", ".join(f"{c} {t}" for c, t in EVENT_COLUMNS.items())
        base = {"session_id": session, "run_id": session, "task_id": "task", "raw_type": "event"}
        full = [{**dict.fromkeys(EVENT_COLUMNS), **base, **row} for row in rows]
        return spark.createDataFrame([tuple(r[c] for c in EVENT_COLUMNS) for r in full], schema)

    return make
