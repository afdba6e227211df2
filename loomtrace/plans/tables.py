"""Derived tables that several registered queries share, materialised once per session.

A deployment writes these as tables; here they are checkpointed in the shared folder.
"""

from __future__ import annotations

import functools

from loomtrace.session import cut_lineage

_made: dict = {}


def shared(fn):
    """Materialise the result once per session and data folder."""

    @functools.wraps(fn)
    def get(spark, sf):
        key = (spark.sparkContext.applicationId, sf, fn.__module__, fn.__name__)
        if key not in _made:
            _made[key] = cut_lineage(fn(spark, sf))
        return _made[key]

    return get


def forget(keep: tuple[str, ...] = ()) -> None:
    """Drop the shared tables but those of the named functions."""
    for key in [k for k in _made if k[-1] not in keep]:
        del _made[key]
