"""The count query and the first-seen filter over streams of files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import NOUNS, TreeQuery, match, order_counts
from ..plans.treebank import sentences


def document_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Documents as Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


#: The settings that put state into RocksDB.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def on_disk_state(spark: SparkSession) -> None:
    """Keeps the state of queries started from now on in RocksDB: it may outgrow an executor's heap."""
    for key, value in ON_DISK.items():
        spark.conf.set(key, value)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """As ``on_disk_state``, for queries that start and end within; the session's own settings come back."""
    before = {key: spark.conf.get(key, None) for key in ON_DISK}
    on_disk_state(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def first_seen(stream: DataFrame, *identity: str, time: str | None = None, horizon: str | None = None) -> DataFrame:
    """Rows whose identity has not come before.

    Without a horizon the state has one key for each identity ever seen, as an exact answer over
    all time needs; use ``on_disk_state``. With ``time`` and ``horizon`` (such as "7 days") keys
    older than the horizon behind the watermark are dropped, and a repeat after it counts as new.
    """
    if horizon is None:
        return stream.dropDuplicates(list(identity))
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(list(identity))


def running_order_counts(stream: DataFrame, group: str = "lang", query: TreeQuery = NOUNS) -> DataFrame:
    """Order counts that grow with the stream: matching is within the row, so the only state is the counts."""
    return order_counts(match(sentences(stream, group), query), group)


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Writes complete counts to an in-memory table; a restart goes on from the checkpoint's files."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
