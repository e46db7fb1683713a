"""Pages of rows, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recent(items: DataFrame, limit: int = 90, offset: int = 0, time: str = "modified_at", key: str = "id") -> DataFrame:
    return items.orderBy(F.desc(time), F.desc(key)).offset(offset).limit(limit)


def before(items: DataFrame, cursor_time, cursor_key, limit: int = 90, time: str = "modified_at", key: str = "id") -> DataFrame:
    """The page after a cursor: the compound predicate reaches the scan, so earlier pages are never read again."""
    t = F.lit(cursor_time)
    rows = items.filter((F.col(time) <= t) & ((F.col(time) < t) | (F.col(key) < cursor_key)))
    return rows.orderBy(F.desc(time), F.desc(key)).limit(limit)


def append(shown: DataFrame, page: DataFrame, key: str = "id") -> DataFrame:
    """Both pages; a row shown before isn't repeated."""
    return shown.unionByName(page.join(shown.select(key), key, "left_anti").select(page.columns))
