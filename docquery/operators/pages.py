"""Pages of sorted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows up to the end of a page that a task may hold; deeper pages are cut out of the whole order, which spills.
MOST = 100_000


def page(rows: DataFrame, skip: int = 0, n: int = 0) -> DataFrame:
    """At most n rows (0: all) after the first ones. The limit comes first, so each task keeps no more than the page's end:
    Spark takes an offset under a limit out of all rows in one task."""
    if n and skip + n <= MOST:
        return rows.limit(skip + n).offset(skip) if skip else rows.limit(n)
    rows = rows.offset(skip) if skip else rows
    return rows.limit(n) if n else rows
