"""The entry point, a streaming run and the registry."""

import __spark_entry__ as entry
from treeloom.plans import registry
from treeloom.sources.tables import load
from treeloom.streaming import counts

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "pattern", "n"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, tmp_path):
    docs = load(spark, DATA, "documents")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = counts.document_stream(spark, str(tmp_path / "in"), docs.schema)
    q = counts.start(counts.running_order_counts(stream), "orders_seen", str(tmp_path / "at"))
    q.processAllAvailable()
    q.stop()
    want = registry.QUERIES["order_counts_noun"](spark, DATA)
    assert sorted(map(tuple, spark.table("orders_seen").collect())) == sorted(map(tuple, want.collect()))
    seen = counts.first_seen(counts.document_stream(spark, str(tmp_path / "in"), docs.schema), "text").writeStream.format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "at2")).start()
    seen.processAllAvailable()
    seen.stop()
    assert spark.table("first_seen").count() == docs.select("text").distinct().count()


def test_first_seen_within_a_horizon(spark, tmp_path):
    """State on disk, and keys that the watermark has left behind count anew."""
    import datetime as dt

    key = "spark.sql.streaming.stateStore.providerClass"
    counts.on_disk_state(spark)
    try:
        at = lambda day: dt.datetime(2026, 1, day)
        batches = [[("a", at(1)), ("b", at(1)), ("a", at(2))], [("c", at(20))], [("a", at(21)), ("c", at(21))]]
        (tmp_path / "in").mkdir()
        stream = counts.first_seen(spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in")), "k", time="t", horizon="3 days")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, "k string, t timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            q.awaitTermination()
        seen = sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert seen == ["a", "a", "b", "c"]
    finally:
        for name in (key, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"):
            spark.conf.unset(name)
