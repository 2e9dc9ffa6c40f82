"""Streams give what the batch operators give on the same input."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewell.operators import intervals, segmenter, transport
from tidewell.sources import binary
from tidewell.streaming import stateful as st


@pytest.fixture()
def events(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")).withColumn("bytes", F.round(F.col("value") * 1000).cast("long"))
    for i in range(3):  # one file a micro-batch, in order
        e.where((F.col("event_id") >= i * 334) & (F.col("event_id") < (i + 1) * 334)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return e, str(tmp_path / "in")


def run(spark, path, schema, make, name):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_live_segments(spark, events):
    e, path = events
    got = run(spark, path, e.schema, lambda s: st.live_segments(s, ["user_id"], "event_id", "value", F.col("event_type") == "view", 60.0, 90.0), "seg")
    cut = segmenter.assign_segments(e, ["user_id"], ["event_id"], "value", F.col("event_type") == "view", 60.0, 90.0)
    batch = segmenter.build_segments(cut, ["user_id"], "event_id", "value", F.col("event_type") == "view")
    want = {r[:2]: r for r in rows(batch.select("user_id", "segment_index", "frames", "duration", "first_frame", "last_frame", "independent"))}
    # all but the segments still open at the end
    assert got and all(want[g[:2]][2:] == pytest.approx(g[2:]) for g in got)
    last = {}
    for u, s in want:
        last[u] = max(last.get(u, 0), s)
    assert {k for k in want if k[1] < last[k[0]]} <= {g[:2] for g in got}


def test_breaker_and_epochs(spark, events):
    e, path = events
    e2 = e.withColumn("ok", F.col("event_type") != "error")
    got = run(spark, path, e.schema, lambda s: st.circuit_breaker(s.withColumn("ok", F.col("event_type") != "error"), ["user_id"], "event_id", "at", "ok", 2, 86400.0), "brk")
    assert got == rows(transport.circuit_breaker(e2, ["user_id"], ["event_id"], "at", "ok", 2, 86400.0).select("user_id", "event_id", "breaker", "allowed"))
    got = run(spark, path, e.schema, lambda s: st.key_epochs(s, ["user_id"], "event_id", "at", 200_000.0), "ep")
    assert got == rows(intervals.epochs_elapsed(e, ["user_id"], "event_id", "at", 200_000.0).select("user_id", "event_id", "key_epoch"))


def test_playlist_states(spark, events):
    from tidewell.operators import playlists

    e, path = events
    got = run(spark, path, e.schema, lambda s: st.playlist_states(s, ["user_id"], "event_id", "value", F.col("event_type") == "error", 5), "pls")
    want = playlists.sliding_state(e, ["user_id"], "event_id", "value")
    assert sorted((g[0], g[2], g[1], g[3], g[5]) for g in got) == sorted(tuple(r) for r in want.select("user_id", "event_id", "first_index", "media_sequence", "target_duration").collect())


def test_alerts(spark, events):
    e, path = events
    got = run(spark, path, e.schema, lambda s: st.bandwidth_alerts(s, ["user_id"], "event_id", "at", "bytes", "value", 8000.0), "alr")
    m = transport.bandwidth(e, ["user_id"], (F.col("at") * 1_000_000).cast("long"), "bytes", F.col("value"), 10.0)
    want = transport.bandwidth_alerts(m, ["user_id"], "event_id", F.lit(8000.0)).select("user_id", "event_id", "state")
    assert [g[:3] for g in got] == rows(want)


def test_reframing(spark, tmp_path):
    frames = [binary.adts_header(2, 48000, 2, n) + bytes([n % 250] * n) for n in (100, 37, 400, 5, 1000, 64)]
    data = b"".join(frames)
    for i, at in enumerate(range(0, len(data), 333)):
        spark.createDataFrame([(1, i, data[at : at + 333])], "k long, i long, content binary").coalesce(1).write.parquet(str(tmp_path / f"{i}"))
    schema = spark.read.parquet(str(tmp_path / "0")).schema
    got = run(spark, str(tmp_path), schema, lambda s: st.framed(s, ["k"], "i", "content"), "adts")
    assert sorted(g[2] for g in got) == sorted(map(len, frames))
    assert {g[3] for g in got} == {48000}


def test_windowed_bandwidth(spark, events):
    e, path = events
    got = run(spark, path, e.schema, lambda s: st.windowed_bandwidth(s.withColumn("ts", F.timestamp_seconds("at")), ["event_type"], "ts", F.col("bytes"), F.col("value"), "1 day", "1 day"), "win")
    batch = e.groupBy(F.window(F.timestamp_seconds("at"), "1 day").alias("w"), "event_type").agg(F.sum("bytes").alias("b"))
    want = {(r.w.start, r.event_type): r.b for r in batch.collect()}
    assert got and all(want[g[0], g[2]] == g[3] for g in got)


def test_new_files_of_any_name_are_read_once(spark, tmp_path):
    """A file whose name sorts before those that were read is new all the same."""
    from tidewell.sources import datasource

    datasource.register(spark)
    folder, frame = tmp_path / "in", binary.adts_header(2, 48000, 2, 5) + b"x" * 5
    folder.mkdir()

    def drain():
        q = spark.readStream.format("adts").option("path", str(folder)).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "b1").write_bytes(frame)
    assert drain() == ["b1"]
    (folder / "a2").write_bytes(frame)
    assert drain() == ["a2", "b1"]


def test_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.aac").write_bytes(binary.adts_header(2, 48000, 2, 5) + b"x" * 5)
    frames = binary.adts_table(binary.stream_files(spark, str(tmp_path / "in")))
    frames.writeStream.format("memory").queryName("streamed_files").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("streamed_files").count() == 1
