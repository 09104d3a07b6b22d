"""Stream results equal the batch operators'."""

import hashlib

from pyspark.sql import functions as F

from wardstone.operators import lifecycle
from wardstone.plans.histories import log
from wardstone.sources.model import Model
from wardstone.streaming.arbitration import activity_windows, arbitrated_stream, chained_stream


def drained(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def test_arbitration(spark, sf, tmp_path):
    rows = log(Model(spark, sf)).select(*lifecycle.KEY, "request_hash", "request_id", "requested_at")
    rows.orderBy("requested_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in drained(spark, arbitrated_stream(stream), "arbitrated").collect()}
    assert got == {tuple(r) for r in lifecycle.replayed_log_ttl(rows, 86_400).collect()}


def test_records_can_be_dropped(spark, tmp_path):
    """With keep_seconds a key's record goes when the watermark has passed it; without, another hash stays a mismatch."""
    schema = "workspace_id long, principal_id long, route_code string, key_hash string, request_hash string, request_id long, requested_at timestamp"
    for i, (key, asked, day) in enumerate([("a", "x", 1), ("b", "x", 4), ("c", "x", 5), ("a", "y", 6)]):
        row = spark.range(1).selectExpr("null as workspace_id", "1L as principal_id", "'r' as route_code", f"'{key}' as key_hash", f"'{asked}' as request_hash", f"{i}L as request_id", f"timestamp '2024-01-0{day} 00:00:00' as requested_at")
        row.selectExpr("cast(workspace_id as bigint) as workspace_id", *[x.split()[0] for x in schema.split(", ")[1:]]).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    for keep, last in ((3600, "Acquired"), (None, "Mismatch")):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in[0-3]"))
        got = {r["request_id"]: r["outcome"] for r in drained(spark, arbitrated_stream(source, 3600, keep), f"kept_{keep}").collect()}
        assert got == {0: "Acquired", 1: "Acquired", 2: "Acquired", 3: last}


def test_chain_over_two_batches(spark, tmp_path):
    for i in range(2):
        spark.range(6).select((F.col("id") % 2).alias("workspace_id"), (F.col("id") + 6 * i).alias("event_id"), F.concat(F.lit("b"), F.col("id") + 6 * i).alias("body")).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    source = spark.readStream.schema("workspace_id long, event_id long, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in[01]"))
    rows = drained(spark, chained_stream(source), "chained").orderBy("workspace_id", "sequence").collect()
    assert [r["sequence"] for r in rows] == [1, 2, 3, 4, 5, 6] * 2
    last = None
    for r in rows[:6]:
        last = hashlib.sha256((bytes.fromhex(last) if last else b"") + b"\0" + f"b{r['event_id']}".encode()).hexdigest()
        assert r["event_hash"] == last


def test_windows(spark, sf, tmp_path):
    rows = Model(spark, sf).audit_source.select(F.col("occurred_at").cast("timestamp").alias("occurred_at"), "workspace_id", "action_code")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drained(spark, activity_windows(stream), "windows", "complete").agg(F.sum("count")).first()[0]
    assert got == rows.count()
