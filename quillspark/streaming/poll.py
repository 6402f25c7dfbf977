"""Streams: a store's changed files, and keys that were never seen before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.embed import Encoder
from quillspark.plans.index import Summary, absorb
from quillspark.plans.store import Store
from quillspark.session import setting
from quillspark.sources import mail

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def poll(spark: SparkSession, store: Store, stores: dict[str, str], encoder: Encoder, state: str, seconds: int | None = 60, mailing_lists: bool = False, on_cycle: Callable[[Summary], None] | None = None) -> StreamingQuery:
    """Brings the store up to date whenever files of ``stores`` changed; a batch reads those only, and none starts without a change.

    ``state``: the folder for the stream's checkpoint and the manifests its offsets name; a restart goes on from there, and a batch that was
    cut short is absorbed again. ``seconds`` between looks, or None to stop when all is up to date.
    """
    changed = mail.follow(spark, stores, f"{state}/manifests")

    def write(batch: DataFrame, _: int) -> None:
        summary = absorb(store, batch, list(stores), encoder, mailing_lists)
        if on_cycle:
            on_cycle(summary)

    writer = changed.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint")
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def first_seen(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose key was never seen before, of equal ones any. Null is a key like any other.

    Without ``time`` every key is remembered for good, and a row counts whenever it comes. With it keys are remembered for ``delay`` after their
    row's time, so state is bounded; rows later than that are passed over.
    """
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def upsert_first(stream: DataFrame, path: str, checkpoint: str, keys: str | list[str] = "message_id", time: str | None = None, delay: str = "1 day", seconds: int | None = None) -> StreamingQuery:
    """Appends to a Parquet table the rows whose key was never seen, across batches and restarts.

    Keys are remembered in a state store on disk (RocksDB), saved with the checkpoint: no batch reads the table. A batch that is replayed
    finds the state of its start and replaces its own files, which the table's log names only once.
    """
    new = first_seen(stream, [keys] if isinstance(keys, str) else keys, time, delay)
    writer = new.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    with setting(stream.sparkSession, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        return writer.start()
