"""Streams give what the same tables give in one go."""

import pytest
from pyspark.sql import functions as F

from larkspur.streaming import events, replay

SCHEMA = "event_id long, ts timestamp, user_id long"


def run(spark, folder, build):
    name = f"s{abs(hash(folder))}"
    stream = build(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("stream") / "events")
    minute = 60
    rows = [(k, k * 7 * minute, k % 3) for k in range(60)] + [(99, 30 * 86_400, 7)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id")
    for part in (df.where("event_id < 30"), df.where("event_id BETWEEN 30 AND 98"), df.where("event_id = 99")):
        part.coalesce(1).write.mode("append").parquet(out)
    return out


def test_window_totals(spark, folder):
    got = {(r.user_id, str(r.window_start)): r.value for r in run(spark, folder, lambda s: events.window_totals(s, "user_id", F.lit(1))).collect()}
    batch = spark.read.parquet(folder).where("event_id < 99").groupBy("user_id", F.window("ts", "1 hour").alias("w")).count()
    assert got == {(r.user_id, str(r.w.start)): r["count"] for r in batch.collect()}


def test_first_seen(spark, folder):
    got = {r.user_id for r in run(spark, folder, lambda s: events.first_seen(s, "user_id", late="2 days")).collect()}
    assert got == {0, 1, 2, 7}


def test_a_range_is_written_by_many_tasks_and_is_one_batch(spark, tmp_path):
    """Ranges of few rows too: what they lack in files is made up with empty ones, so no range is cut or joined with the next."""
    rows = spark.range(0, 900, numPartitions=3).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts")).unionByName(spark.createDataFrame([(-1, None)], "event_id long, ts timestamp"))
    for name, part in (("many", rows), ("few", rows.where("event_id < 3"))):
        stream = replay.in_order(part, "ts", 3, str(tmp_path / name))
        told = []
        query = stream.writeStream.foreachBatch(lambda batch, k, told=told: told.append(sorted(r.event_id for r in batch.collect()))).option("checkpointLocation", str(tmp_path / f"{name}-at")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert len(told) == 3 and [x for batch in told for x in batch] == sorted(r.event_id for r in part.collect())
    assert len([f for f in spark.read.parquet(str(tmp_path / "many")).inputFiles()]) == 3 * spark.sparkContext.defaultParallelism
