"""Incremental edges: new child rows of a stream joined with the known parents, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_edges(stream: DataFrame, fk: str, parents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes (child columns, row_gid of the parent) for every batch; parents has pk and row_gid. Batches are idempotent."""

    def one(batch: DataFrame, number: int) -> None:
        batch.join(parents, batch[fk] == parents.pk).drop("pk").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
