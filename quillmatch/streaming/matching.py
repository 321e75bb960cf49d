"""Queries from a stream: each micro-batch is a batch search in a static index, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillmatch.config import MatchOptions
from quillmatch.operators.index import Index
from quillmatch.operators.sinks import match_lines
from quillmatch.plans.search import match


def match_stream(queries: DataFrame, index: Index, out: str, checkpoint: str, o: MatchOptions = MatchOptions(), lines: bool = False, **trigger) -> StreamingQuery:
    """Write the matches (or result lines) of a stream (q_id, text) as Parquet, a folder for each micro-batch.

    A batch that is repeated after a failure overwrites its own folder, so each result is there once. Results carry q_id; order is by it.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = match(batch, index, o)
        (match_lines(batch, found) if lines else found).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
