"""First-write-wins ingest of a stream of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from themeflow.operators import store
from themeflow.operators.id_index import IdIndex
from themeflow.operators.staging import stage, staged_within


def write_batch(batch: DataFrame, batch_id: int, path: str, arrival: str, index: IdIndex) -> None:
    """Append what is new to the store and its ids to the index.

    Only buckets of the index that may hold an id of the batch are read, never the store.  A batch
    that is run again after a failure replaces its own folder and segment and does not look at them,
    so the outcome is the same.  Rows are ranked by their numbers, without the texts; those that win are written.
    """
    with staged_within(batch.sparkSession):
        batch = stage(batch.withColumn("__row", F.monotonically_increasing_id()), "stream-batch")
        known = index.known(batch, before=batch_id)
        firsts = stage(store.new_posts(batch, index, arrival, known=known).select("id", "__row"), "stream-firsts")
        index.add(firsts, batch_id)
        fresh = batch.join(firsts.select("__row"), "__row", "left_semi").drop("__row")
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def ingest_stream(
    posts: DataFrame, path: str, arrival: str, checkpoint: str, index: IdIndex | None = None
) -> DataStreamWriter:
    """Exact de-duplication against everything stored; memory of it is the index (by default beside the store)."""
    ids = index or IdIndex(f"{path}-ids")
    return posts.writeStream.foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, path, arrival, ids)
    ).option("checkpointLocation", checkpoint)


def deduplicated_within(posts: DataFrame, delay: str) -> DataFrame:
    """Bounded variant: copies are recognised only within the watermark delay."""
    return posts.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["id"])
