"""Writers, probes, pipeline rows and the push sink."""

import struct

import pytest
from pyspark.sql import functions as F

from tidewell.operators import ladders, pipeline
from tidewell.sources import binary, probe, writers
from tidewell.streaming.push import push_rows


def test_init_segment():
    data = writers.init_segment([{"id": 1, "kind": "video", "timescale": 90000, "codec": "h264", "width": 1280, "height": 720, "config": b"\1abc"}, {"id": 2, "kind": "audio", "timescale": 48000, "language": "eng", "rate": 48000, "channels": 2}, {"id": 3, "kind": "text", "timescale": 1000}])
    paths = [b[0] for b in binary.boxes(data)]
    assert paths[:3] == ["/ftyp", "/moov", "/moov/mvhd"] and paths.count("/moov/trak") == 3 and paths.count("/moov/mvex/trex") == 3
    rows = binary.tracks(data)
    assert [(r[1], r[2], r[4], r[10]) for r in rows] == [("vide", 90000, "und", 0), ("soun", 48000, "eng", 0), ("subt", 1000, "und", 0)] and all(r[13] is None for r in rows)
    assert b"avcC\1abc" in data and b"esds" in data and writers.audio_config(2, 48000, 2) == bytes([0x11, 0x90])


def test_events_and_protection():
    e = binary.boxes(writers.emsg("urn:x", "1", 90000, 1 << 40, 90000, 7, b"data"))[0]
    assert e[1] == "emsg" and e[7].endswith(b"urn:x\x001\0data") and struct.unpack_from(">Q", e[7], 8)[0] == 1 << 40
    p = writers.pssh(ladders.SYSTEM_IDS["widevine"], b"key")
    assert len(p) == 4 + 4 + 4 + 16 + 4 + 3 and p[12:16].hex() == "edef8ba9"


def test_splice_round_trip():
    one = lambda *a, **k: binary.splice_info(writers.splice_section(*a, **k))
    assert one("splice_null") == [("splice_null", None, None, None, None, None)]
    assert one("splice_insert", 9, True, 900000, 2700000) == [("splice_insert", 9, True, 900000, 2700000, False)]
    assert one("splice_insert", 9) == [("splice_insert", 9, False, None, None, True)]
    assert one("time_signal", pts=(1 << 32) + 5) == [("time_signal", None, None, (1 << 32) + 5, None, None)]


def test_hevc_profile():
    out = "".join(["0000", "000", "1", "00", "0", "00010", "0" * 32, "0" * 48, f"{123:08b}", "1", "010", f"{1281:021b}", f"{721:019b}"])
    raw = bytes(int(out[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(out), 8))
    got = writers.hevc_profile(b"\x42\x01" + raw)
    assert (got["profile"], got["level"], got["chroma"], got["width"], got["height"]) == (2, 123, 1, 1280, 720)
    assert writers.hevc_profile(b"x") is None


def test_probe(spark):
    js = '{"format":{"duration":"12.5"},"streams":[{"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":2},{"codec_type":"video","codec_name":"h264","width":1280,"height":720,"r_frame_rate":"30000/1001","bit_rate":"5000000"}]}'
    df = spark.createDataFrame([(js, "a/b.MP4", "x time=01:02:03.50 y"), ("nope", "a.mkv", "none")], "j string, p string, l string")
    a, b = df.select(probe.source_info(F.col("j")).alias("i"), probe.is_container(F.col("p")).alias("c"), probe.progress_seconds(F.col("l")).alias("s")).collect()
    assert (a.i.duration, a.i.width, a.i.video_codec, a.i.sample_rate, a.c, a.s) == (12.5, 1280, "h264", 48000.0, True, 3723.5) and a.i.frame_rate == pytest.approx(29.97003)
    assert (b.c, b.s) == (False, None) and (b.i is None or not b.i.has_video)


def test_pipeline_rows(spark):
    s = spark.createDataFrame([(1, i, 2.0, 10) for i in range(6)], "k long, i long, d double, n long")
    t = sorted(pipeline.ticks(s, ["k"], "i", "d", "n", 2).collect(), key=lambda r: r.i)
    assert [(r.segments_so_far, r.seconds_so_far, r.bytes_so_far) for r in t] == [(i + 1, 2.0 * (i + 1), 10 * (i + 1)) for i in range(6)]
    assert sorted(r.i for r in pipeline.record(s, ["k"], "i", "d", 7.0, 2).collect()) == [0, 1, 2]
    items = spark.createDataFrame([(1, 0.0, "a"), (1, 0.5, "b"), (1, 99.0, "c")], "k long, t double, x string")
    seg = s.withColumn("begin", F.col("i") * 2.0)
    assert {r.x: r.segment for r in pipeline.attach_metadata(items, seg, ["k"], "t", "i", "begin").collect()} == {"a": 0, "b": 1, "c": None}
    tracks = spark.createDataFrame([(1, 0, "a/atmos.m3u8"), (1, 1, "x.m3u8")], "k long, o long, uri string")
    r = sorted((x.o, x.kind, x.is_default, x.uri) for x in pipeline.audio_renditions(tracks, ["k"], "o").collect())
    assert r == [(0, "spatial", True, "a/atmos.m3u8"), (0, "stereo", False, "a/stereo.m3u8"), (1, "spatial", False, "x.m3u8"), (1, "stereo", False, "x_stereo.m3u8")]
    k = {x.s: x for x in pipeline.session_keys(spark.createDataFrame([("fairplay",), ("widevine",)], "s string"), "s", F.lit("u")).collect()}
    assert k["fairplay"].method == "SAMPLE-AES" and k["widevine"].key_format.startswith("urn:uuid:edef")
    assert {len(x[0]) for x in spark.range(3).select(pipeline.random_key()).collect()} == {16}
    q = spark.createDataFrame([("poor", "connected"), ("good", "connected"), ("good", "failed")], "g string, s string")
    assert sorted(x.event for x in pipeline.route_quality(q, F.col("g"), F.col("s")).collect()) == ["degraded", "failed"]
    p = spark.createDataFrame([("everyNSegments", 10.0, 10, 0), ("everyNSegments", 10.0, 9, 0), ("everyNSegments", 5.0, 14, 10), ("everyNSegments", 5.0, 15, 10), ("none", 0.0, 1, 0)], "kind string, n double, seg int, last int")
    assert [x[0] for x in p.select(pipeline.rotates(F.col("kind"), F.col("n"), F.col("seg"), F.lit(0.0), F.col("last"))).collect()] == [True, False, False, True, False]
    assert p.select(pipeline.describe_policy(F.col("kind"), F.col("n"))).first()[0] == "Rotate every 10 segments"


def test_push():
    waits, now = [], [0.0]
    codes = iter([503, 200, 404, *[500] * 16, 200])
    out = push_rows(range(9), lambda r: next(codes), "default", waits.append, lambda: now[0])
    assert waits[0] == 1.0 and out["sent"] == 1 and out["failed"] == 5 and out["rejected"] == 3
    out = push_rows(range(1), lambda r: (_ for _ in ()).throw(OSError()), "conservative", waits.append, lambda: 0.0)
    assert out == {"sent": 0, "failed": 1, "attempts": 3, "rejected": 0}
