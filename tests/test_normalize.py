"""Echo state over spans against a walk along the log; lines that are no UTF-8."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import normalize as N
from loomtrace.session import cut_lineage
from loomtrace.sources import logs

SILVER = "session_id string, seq bigint, event_type string, raw_type string, parse_status string, reason_unparsed string, p_type string, role string, phase string, text string"


def brute(rows):
    kept = []
    for session in {r[0] for r in rows}:
        before, opener = None, None
        for r in sorted((r for r in rows if r[0] == session), key=lambda r: r[1]):
            _, _, event_type, origin, status, _, p_type, role, phase, text = r
            if event_type in ("patch.apply.duplicate", "agent.session.foreign") or status == "unparsed":
                kept.append(r)
                continue
            message = None
            if (origin, p_type) in (("response_item", "message"), ("event_msg", "agent_message"), ("event_msg", "user_message")):
                message = (role, (phase or "").strip() or None, (text or "").strip())
            if message is None or not message[2] or message != before:
                opener = origin
            if message is None or origin == opener:
                kept.append(r)
            before = message
    return sorted(kept)


def random_log(seed, n=400):
    draw, rows = random.Random(seed), []
    for s in "ab":
        for seq in range(1, n + 1):
            kind = draw.choice(["message"] * 6 + ["other", "skip", "bad"])
            origin, p_type = draw.choice([("response_item", "message"), ("event_msg", "agent_message")])
            if kind == "message":
                rows.append((s, seq, "message.agent", origin, "parsed", None, p_type, draw.choice("uu" + "v"), draw.choice([None, ""]), draw.choice(["x", "x ", "x", "y", ""])))
            else:
                event_type = {"other": "tool.call", "skip": "patch.apply.duplicate", "bad": "raw.unparsed"}[kind]
                rows.append((s, seq, event_type, origin, "unparsed" if kind == "bad" else "parsed", None, "z", None, None, None))
    return rows


@pytest.mark.parametrize("seed,span", [(1, 3), (2, 7), (3, 50), (4, 1_000_000)])
def test_echoes_over_spans(spark, seed, span):
    rows = random_log(seed) + [("c", i, "message.agent", "event_msg" if i % 3 else "response_item", "parsed", None, "agent_message" if i % 3 else "message", "u", None, "same") for i in range(1, 60)]
    got = N.drop_message_echo(spark.createDataFrame(rows, SILVER), span).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1])) == sorted(brute(rows), key=lambda r: (r[0], r[1]))


def test_silver_is_written_once_and_dealt_once(spark, monkeypatch):
    rows = spark.createDataFrame([("s", "p", i, json.dumps({"type": "event_msg", "payload": {"type": "agent_message", "message": "m"}}), "t") for i in range(1, 9)], "session_id string, path string, seq bigint, value string, read_at string")
    bronze = cut_lineage(N.parse_lines(rows))
    writes = []
    monkeypatch.setattr(N, "cut_lineage", lambda df: writes.append(1) or cut_lineage(df))
    events = N.normalize_session(bronze)
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert len(writes) == 1 and "LeftAnti" not in plan and plan.count("Relation [") == 2
    assert events.count() == 8


def test_lines_that_are_no_utf8(spark, tmp_path):
    good = json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": "é"}}, ensure_ascii=False).encode()
    lines = [good, b'{"type":"event_msg","a":"\xff\xe9\xe2\x82"}', b"\xc3", b"", good + b"\r", b'{"broken"', b"\xf0\x9f\x98 tail\r"]
    (tmp_path / "rollout-2026-04-07T10-00-00-abc.jsonl").write_bytes(b"\n".join(lines))
    bronze = cut_lineage(N.parse_lines(logs.session_lines(spark, str(tmp_path))))
    got = N.quarantine(N.normalize_session(bronze)).orderBy("seq").collect()
    shown = [b.rstrip(b"\r").decode("utf-8", errors="replace") for b in lines if b]
    assert [tuple(r) for r in got] == [
        ("abc", 2, "unparsed", "invalid_utf8", shown[1]), ("abc", 3, "unparsed", "invalid_utf8", shown[2]),
        ("abc", 5, "unparsed", "invalid_json", shown[4]), ("abc", 6, "unparsed", "invalid_utf8", shown[5]),
    ]
    assert bronze.where(F.col("raw_type") == "event_msg").count() == 2
