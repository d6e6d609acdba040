"""Specifications that arrive as a stream: each micro-batch runs through the ladder of checks and is handed to a sink.

Rows of one specification must arrive in one batch (one file, or one key of the source). A batch that is run again gives the same rows, so a sink that overwrites by batch number is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import solve


def run_stream(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Starts `solve.run` over a stream of specification rows; `sink` takes each batch's results and its number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(solve.run(batch, **options), number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
