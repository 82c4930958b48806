"""Matching over a stream of labels: each label depends on the index alone, so every micro-batch is matched
on its own and appended.  Labels that repeat within a batch are matched once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Matcher
from ..operators.match import match_all


def match_stream(labels: DataFrame, matcher: Matcher, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that writes matches of (id, label) rows below ``sink``, a folder for each batch.

    A batch that is tried again overwrites its own folder, so no match is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        match_all(batch, matcher).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = labels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
