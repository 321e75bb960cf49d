"""Dense numbers in a given order, without sorting all rows in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.sources.store import kept

_BITS = 33  # of a row within its partition, in monotonically_increasing_id


def tasks(df: DataFrame) -> int:
    """As many as the session shuffles with; given as a number, so that work that is heavy for its bytes isn't put together in few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[str], out: str, path: str, start: int = 0, each: Callable[[DataFrame], DataFrame] = lambda x: x, spread: list[str] | None = None) -> DataFrame:
    """each(df) with numbers from `start` in the order of the columns. `each` may add columns and rows and drop some; it runs once, after rows are spread by `spread`, the first of the order columns (by default all).

    Rows are sorted by range over as many tasks as the session shuffles with, and written to the path with their place in the task,
    so that a lost executor can't change it. A task's rows then move up by the rows of the tasks before it (one row for each task).
    """
    placed = kept(each(df.repartitionByRange(tasks(df), *(spread or order))).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), path)
    task = F.shiftright("_at", _BITS)
    counts = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_base"))
    number = F.col("_base") + F.col("_at") - F.shiftleft("_task", _BITS) + start
    return placed.withColumn("_task", task).join(F.broadcast(base), "_task").withColumn(out, number.cast("long")).drop("_task", "_at", "_base")
