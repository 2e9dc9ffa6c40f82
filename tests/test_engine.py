"""The front, data sources and transport streams."""

import os

import pytest
from pyspark.sql import functions as F

from tests.test_manifest import GOOD_MASTER, GOOD_MEDIA
from tidewell import engine
from tidewell.sources import binary, datasource, tags
from tidewell.sources import transport_stream as ts


def test_front(spark):
    df = spark.createDataFrame([(1, GOOD_MASTER), (2, GOOD_MEDIA), (3, "x")], "doc_id long, text string")
    tables, findings = engine.parse_and_validate(df)
    assert {r.doc_id: r.kind for r in tables["kinds"].collect()} == {1: "master", 2: "media", 3: None}
    assert tables["variants"].count() == 3 and tables["segments"].count() == 2 and {r.doc_id for r in findings.collect()} == {3}
    once = engine.regenerate(df)
    text = once.first().text
    assert text == GOOD_MEDIA.replace("6.0,A", "6.0,A") and engine.regenerate(once).first().text == text


def test_segment_and_encrypt(spark):
    frames = spark.createDataFrame([(1, i, 0.5, i % 4 == 0, bytes([i])) for i in range(20)], "s long, i long, d double, k boolean, data binary")
    segments, lists = engine.segment(frames, ["s"], "i", "d", F.col("k"), 3.0)
    assert [(r.segment_index, r.samples) for r in segments.orderBy("segment_index").collect()] == [(0, 8), (1, 8), (2, 4)]
    text = lists.first().text
    assert text.count("#EXTINF:4.000,") == 2 and text.endswith("segment_2.m4s\n#EXT-X-ENDLIST\n") and '#EXT-X-MAP:URI="init.mp4"' in text
    out = engine.transform(engine.encrypt(frames, "data", F.lit(bytearray(16)), "i"), lambda d: d.where("i < 3"))
    assert {len(r.encrypted) for r in out.collect()} == {16}


def test_data_sources(spark, tmp_path):
    datasource.register(spark)
    for n in range(3):
        (tmp_path / f"{n}.aac").write_bytes(b"".join(binary.adts_header(2, 48000, 2, 10 + n) + b"x" * (10 + n) for _ in range(4)))
    rows = spark.read.format("adts").option("path", str(tmp_path)).load()
    assert rows.count() == 12 and {os.path.basename(r.path): r.length for r in rows.collect()} == {"0.aac": 17, "1.aac": 18, "2.aac": 19}
    q = spark.readStream.format("adts").option("path", str(tmp_path)).load().writeStream.format("memory").queryName("adts_s").start()
    try:
        q.processAllAvailable()
        assert spark.table("adts_s").count() == 12
        (tmp_path / "3.aac").write_bytes(binary.adts_header(2, 48000, 2, 1) + b"y")
        q.processAllAvailable()
        assert spark.table("adts_s").count() == 13
    finally:
        q.stop()


def test_transport_stream(spark):
    frames = [(ts.VIDEO, 90000, 87000, True, b"v" * 1000), (ts.AUDIO, 90000, None, False, b"a" * 150), (ts.VIDEO, 93000, None, False, b"w"), (ts.AUDIO, 1 << 32, None, False, b"b" * 175), (ts.VIDEO, 5, None, False, b"z" * 169)]
    data = ts.segment(frames)
    assert len(data) % 188 == 0 and all(data[i] == 0x47 for i in range(0, len(data), 188))
    got = sorted((pid, pts, dts, payload) for pid, _, pts, dts, ok, payload in ts.units(b"junk" + data) if ok)
    assert got == sorted((p, t, d, x) for p, t, d, _, x in frames)
    counters = {}
    for i in range(0, len(data), 188):
        pid = (data[i + 1] & 31) << 8 | data[i + 2]
        assert data[i + 3] & 15 == counters.get(pid, 0) & 15
        counters[pid] = counters.get(pid, 0) + 1
    # a table's checksum comes out as 0 over table and checksum
    pat = data[5 : 5 + 3 + 13]
    assert binary.crc32_mpeg(pat) == 0
    df = spark.createDataFrame([("a", data), ("b", b"")], "path string, content binary")
    assert ts.unit_table(df).count() == 5


def test_tag_writers(spark):
    one = lambda c, **cols: spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or [F.lit(1)]).select(c).first()[0]
    assert one(tags.start_line(F.lit(-3.5), F.lit(True))) == "#EXT-X-START:TIME-OFFSET=-3.5,PRECISE=YES"
    assert one(tags.skip_line(F.lit(7), F.array(F.lit("a"), F.lit("b")))) == '#EXT-X-SKIP:SKIPPED-SEGMENTS=7,RECENTLY-REMOVED-DATERANGES="a\tb"'
    assert one(tags.define_line(), name="n", value="v", kind="value") == '#EXT-X-DEFINE:NAME="n",VALUE="v"'
    assert one(tags.define_line(), name="n", value="", kind="import") == '#EXT-X-DEFINE:IMPORT="n"'
    assert one(tags.steering_line(), server_uri="/s", pathway_id="A") == '#EXT-X-CONTENT-STEERING:SERVER-URI="/s",PATHWAY-ID="A"'
    assert one(tags.part_inf_line(F.lit(0.33334))) == "#EXT-X-PART-INF:PART-TARGET=0.333"
    assert one(tags.rendition_report_line(), uri="u", last_msn=3, last_part=1) == '#EXT-X-RENDITION-REPORT:URI="u",LAST-MSN=3,LAST-PART=1'


def test_command_line(spark, tmp_path, capfd):
    from tidewell.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.m3u8").write_text(GOOD_MEDIA)
    assert main(["validate", str(tmp_path / "in"), "--strict"], spark) == 0
    assert main(["regenerate", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).first().text == GOOD_MEDIA
    (tmp_path / "in/bad.m3u8").write_text(GOOD_MEDIA.replace("TARGETDURATION:6", "TARGETDURATION:0"))
    assert main(["validate", str(tmp_path / "in")], spark) == 2 and main(["info", str(tmp_path / "in")], spark) == 0
