"""Stored metrics after each batch against the batch job over what has landed."""

from pyspark.sql import functions as F

from loomtrace.operators import operations, session_metrics
from loomtrace.operators.catalog import catalog_row, with_identity
from loomtrace.sources import metrics_store
from loomtrace.streaming.tail import refresh_metrics


def test_store_equals_batch_job_after_every_batch(spark, events_of, tmp_path):
    def batch(session, first, n):
        kinds = ["task.started", "shell.call", "shell.result", "info.tokens", "task.completed"]
        return events_of(
            [
                {"seq": i, "ts": f"2026-04-08T10:00:{i:02d}Z", "event_type": kinds[i % 5], "operation_id": f"o{i // 5}" if i % 5 in (1, 2) else None,
                 "thread_id": "root", "turn_id": f"t{i // 5}", "total_tokens": i * 10 if i % 5 == 3 else None}
                for i in range(first, first + n)
            ],
            session,
        )

    rows = spark.createDataFrame([("a", "main"), ("b", "main")], "session_id string, source string")
    catalog = with_identity(catalog_row(rows, {c: F.col(c) for c in rows.columns}))
    batches = [batch("a", 0, 4).unionByName(batch("b", 0, 7)), batch("a", 4, 6), batch("b", 7, 3)]
    store, landed = str(tmp_path / "store"), str(tmp_path / "landed")
    refresh = refresh_metrics(store, landed, lambda s: catalog)
    shown = ["session_id", "event_count", "operation_count", "tokens_total", "duration_ms"]
    so_far = None
    for number, part in enumerate(batches):
        so_far = part if so_far is None else so_far.unionByName(part)
        for _ in range(2 if number == 1 else 1):  # a batch that is tried again changes nothing
            refresh(part, number)
        made = session_metrics.session_metrics(so_far, operations.project_operations(so_far), catalog)
        order = lambda df: sorted(df.select(*shown).collect(), key=lambda r: r["session_id"])
        assert order(metrics_store.load(spark, store)) == order(made)
    refresh(batches[0].limit(0), 3)
    assert metrics_store.load(spark, store).count() == 2
