import pytest
from pyspark.sql import functions as F

from lastleg.streaming import profile as P


@pytest.fixture
def source(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.unionByName(rows.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    return rows, P.read_events(spark, str(tmp_path / "in"), rows.schema)


def run(stream, name, folder, mode="append"):
    job = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    job.awaitTermination(180)
    return stream.sparkSession.table(name)


def test_windows_over_a_stream(source, tmp_path):
    """Copies go, and every window that the watermark has closed equals that of the whole table."""
    rows, events = source
    got = run(P.windowed_profile(P.deduplicated(events), late=None), "windows", tmp_path)
    want = {(r["window"]["start"], r.event_type): r.n for r in P.windowed_profile(rows.withColumn("ts", F.col("ts").cast("timestamp")), late=None).collect()}
    found = {(r["window"]["start"], r.event_type): r.n for r in got.collect()}
    assert found and all(want[k] == n for k, n in found.items()) and len(found) >= 0.9 * len(want)


def test_sliding_windows_and_sessions(source, tmp_path):
    rows, events = source
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    unique = P.deduplicated(events)
    slid = run(P.windowed_profile(unique, late=None, slide="5 minutes"), "slid", tmp_path).agg(F.sum("n")).first()[0]
    assert 0.9 * 3 * rows.count() <= slid <= 3 * rows.count()
    got = {(r.session_window["start"], r.user_id): r.n for r in run(P.sessions(events.dropDuplicates(["event_id"])), "sessions", tmp_path).collect()}
    want = {(r.session_window["start"], r.user_id): r.n for r in timed.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_state_of_each_sensor(source, tmp_path):
    rows, events = source
    last = run(P.sensor_states(events), "states", tmp_path, "update")
    n = {r.user_id: r.n for r in last.groupBy("user_id").agg(F.max("n").alias("n")).collect()}
    whole = {r.user_id: r.n for r in events.sparkSession.read.schema(rows.schema).parquet(str(tmp_path / "in")).where("value is not null").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert n == whole
