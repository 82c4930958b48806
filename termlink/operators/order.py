"""A total order over a distributed frame without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.stored import stored

_LOCAL = (1 << 33) - 1  # of monotonically_increasing_id: the row within its partition


def numbered(frame: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """0-based place of each row in the order of ``by``.

    Rows are range-partitioned and sorted in their partitions; only the partitions' counts are gathered.
    The sorted frame is stored, so that both uses see the same places; that runs a job.
    """
    held = stored(frame.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    counts = sorted((r.p, r.c) for r in held.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, before = [], 0
    for p, c in counts:
        offsets.append((p, before))
        before += c
    known = frame.sparkSession.createDataFrame(offsets, "_p long, _before long")
    at = F.col("_at").bitwiseAND(_LOCAL) + F.col("_before")
    return held.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(known), "_p").select(*frame.columns, at.alias(name))  # a row per partition
