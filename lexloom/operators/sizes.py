"""Broadcasts behind a check of the size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of them, that are broadcast at most; beyond, a join is left to shuffle.
MOST_ROWS, MOST_BYTES = 300_000, 64 << 20


def rows_if_small(df: DataFrame, most: int = MOST_ROWS) -> pa.Table | None:
    """The rows of a table that has ``most`` rows and ``MOST_BYTES`` at most, or nothing."""
    rows = df.limit(most + 1).toArrow()
    return None if rows.num_rows > most or rows.nbytes > MOST_BYTES else rows


def broadcast_if_small(df: DataFrame, most: int = MOST_ROWS) -> tuple[DataFrame, bool]:
    """The table and whether it has ``most`` rows and ``MOST_BYTES`` at most. Then its rows, which are
    at hand from the count, take its place, marked for broadcast, so what made it runs once."""
    rows = rows_if_small(df, most)
    return (df, False) if rows is None else (F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), True)
