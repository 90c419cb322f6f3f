"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class SlidingWindows:
    """sliding_windows(limit, window, step): (w_start, w_end) of all complete windows from 0 on; none if the limit is null or below the window."""

    def eval(self, limit: int, window: int, step: int) -> Iterator[tuple[int, int]]:
        if window is None or step is None or window <= 0 or step <= 0:
            raise ValueError("window and step must be positive")
        for start in range(0, (-1 if limit is None else limit) - window + 1, step):
            yield start, start + window


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL, for lateral joins."""
    spark.udtf.register("sliding_windows", udtf(SlidingWindows, returnType="w_start bigint, w_end bigint"))
