"""File changes as a stream: micro-batches of listings merged idempotently into a table of hashes.

A batch is one delivery of a store, under the stream's batch number, so that applying it again changes nothing. The state
is the last snapshot and the deliveries since; after COMPACT of these they are merged into the next snapshot. A batch so
costs what it holds, and the whole state is rewritten once in COMPACT batches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylens.operators.increment import CommitStore
from quarrylens.operators.merge import first_by
from quarrylens.runtime import load


def listing_stream(spark: SparkSession, folder: str, schema, per_batch: int = 1_000) -> DataFrame:
    """Listings as they arrive as Parquet files in a folder; at most per_batch files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def coalesced(batch: DataFrame) -> DataFrame:
    """The last listing of each file in a batch: changes that follow each other closely count once."""
    return first_by(batch.where("config_hash is not null and path is not null"), ["config_hash", "path"], [-F.col("run_no"), -F.unix_micros("seen_at")])


#: Deliveries after which the state is merged into a snapshot.
COMPACT = 16


class ListingState:
    """The newest listing of every file that a stream has brought, at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = CommitStore(spark, path)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take a batch in, whatever the order; once only, by its number."""
        number = self.store.deliver(f"batch-{batch_id}", {"listings": coalesced(batch)})
        if number - (self.store.watermark() or -1) >= COMPACT:
            self.compact()

    def compact(self) -> None:
        log = self.store.deliveries()
        self.store.run(log[-1]["number"] if log else None, lambda low, high: self._rows(low, high).withColumn("keep", F.lit(True)))

    def _rows(self, low: int | None, high: int | None) -> DataFrame | None:
        parts = [df for df in (self.store.snapshot(), self.store.delivered("listings", low, high)) if df is not None]
        return coalesced(reduce(DataFrame.unionByName, parts)) if parts else None

    def rows(self) -> DataFrame | None:
        """The state now; None before the first batch."""
        return self._rows(self.store.watermark(), None)


def follow(stream: DataFrame, state_path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Start the stream; without seconds all that is there is processed and the query ends."""
    state = ListingState(stream.sparkSession, state_path)
    writer = stream.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def change_counts(stream: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Listings per build and window of seen_at, with late rows up to a bound."""
    return stream.withWatermark("seen_at", late).groupBy("config_hash", F.window("seen_at", window)).agg(F.count(F.lit(1)).alias("listings"))


def replay(spark: SparkSession, sf_dir: str, scratch: str) -> DataFrame:
    """The state after all listings of a directory went through the stream."""
    source = load(spark, sf_dir, "files")
    source.write.mode("overwrite").parquet(f"{scratch}/in")
    follow(listing_stream(spark, f"{scratch}/in", source.schema), f"{scratch}/state", f"{scratch}/checkpoint").awaitTermination()
    return ListingState(spark, f"{scratch}/state").rows()
