"""Streams read from files in order."""

from pyspark.sql import functions as F

from kairograph.streaming import contacts


def _feed(spark, path):
    rows = [("s", "A", "B", 0), ("s", "B", "C", 60), ("s", "C", "D", 60)]
    df = spark.createDataFrame(rows, "session string, from string, to string, k int").select("session", "from", "to", F.timestamp_seconds(F.col("k") + 1_700_000_000).alias("ts"))
    df.coalesce(1).write.mode("append").parquet(path)
    late = spark.createDataFrame([("s", "Y", "Z", 7200)], "session string, from string, to string, k int").select("session", "from", "to", F.timestamp_seconds(F.col("k") + 1_700_000_000).alias("ts"))
    late.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def _run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = _feed(spark, path)
    got = _run(spark, contacts.windowed_counts(contacts.contact_stream(spark, path, schema), "1 hour"), "counts", "complete")
    assert got.agg(F.sum("contacts")).first()[0] == 4


def test_katz_waits_for_the_watermark(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = _feed(spark, path)
    got = _run(spark, contacts.stream_katz(contacts.contact_stream(spark, path, schema), beta=0.5, late="1 minute"), "katz", "append")
    last = {r["node"]: r["value"] for r in got.collect()}
    assert last.get("C") in (None, 0.75) and last.get("D") in (None, 0.5)
