"""Sketches kept up to date from a stream of (ub_id, h): sketches merge, so order and batches
do not matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sketchloom.functions import hll


def maintain(stream: DataFrame, path: str, checkpoint: str, bits: int = 12) -> StreamingQuery:
    """Append one sketch a user bin and micro-batch to ``path``; a batch that is run again
    replaces its own rows, and merging is idempotent besides."""

    def write(batch: DataFrame, epoch: int) -> None:
        hll.native(batch, bits).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(parts: DataFrame) -> DataFrame:
    """(ub_id, sketch, estimate) of all batches so far."""
    return hll.union(parts, "ub_id").withColumn("estimate", hll.estimate("sketch"))
