"""Registration of the core queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cantus.sources.music import ANNOTATIONS_SQL, NOTES_SQL, SEGMENTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VIEWS = {"seg": SEGMENTS_SQL, "note": NOTES_SQL, "gt": ANNOTATIONS_SQL}


def query(sql: str | None = None, views: tuple[str, ...] = (), more: tuple[str, ...] = ()):
    """Register a query under its function's name. ``views`` and then ``more`` become the WITH clause before ``sql``."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [VIEWS[v] for v in views] + list(more)
            ORACLE[f.__name__] = ("WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" if parts else "") + sql.strip()
        return f

    return register
