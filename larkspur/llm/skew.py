"""Joins of rows to one record per key, when a few keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, hot: int = 1000) -> DataFrame:
    """Inner join of ``rows`` to ``groups``, which has one row per key and the key's row count in column ``size``.

    A key with more than total/hot rows is hot; fewer than ``hot`` keys can be,
    so their records are broadcast under a proven bound.  All other keys go
    through a shuffle in which no key has more than total/hot rows.
    Null keys match nothing.
    """
    limit = total // hot
    large, rest = groups.filter(F.col(size) > limit), groups.filter(F.col(size) <= limit)
    return rows.join(F.broadcast(large), keys).unionByName(
        rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(rest, keys)
    )
