"""Assemble comparison SQL: a query body plus the common table expressions it needs."""

from __future__ import annotations

import re

from loomtrace.plans import fixtures

CTES: dict[str, str] = dict(fixtures.duck_views())


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _used(sql: str) -> set[str]:
    return {n for n in set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql)) if n in CTES}


def build(body: str) -> str:
    needed: set[str] = set()
    pending = _used(body)
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending |= _used(CTES[name]) - needed - {name}
    order = [n for n in CTES if n in needed]
    if not order:
        return body
    recursive = "RECURSIVE " if any(re.search(rf"\bFROM {n}\b|\bJOIN {n}\b", CTES[n]) for n in order) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


def known(expr: str, name: str) -> str:
    return f"{expr} AS {name}, CASE WHEN {expr} IS NULL THEN 'unknown' ELSE 'known' END AS {name}_coverage"


def partial(expr: str, name: str) -> str:
    return f"{expr} AS {name}, CASE WHEN {expr} IS NULL THEN 'unknown' ELSE 'partial' END AS {name}_coverage"


def covered_sum(name: str, out: str | None = None) -> str:
    out = out or name
    return (
        f"CAST(sum({name}) AS BIGINT) AS {out}, CASE WHEN sum({name}) IS NULL THEN 'unknown' "
        f"WHEN bool_and({name}_coverage = 'known') THEN 'known' ELSE 'partial' END AS {out}_coverage"
    )
