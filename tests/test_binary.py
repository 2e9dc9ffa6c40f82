"""Boxes, frames, units, tags: bytes built here, read back."""

import struct

from pyspark.sql import functions as F

from tidewell.operators import crypto, media
from tidewell.sources import binary as B
from tidewell.sources import ttml

SYNC = [1, 31, 61]


def movie(wide=False, drop=()):
    """A video track of 90 samples of 50,000 bytes in chunks of 10."""
    full = B.full_box
    stbl = {
        "stts": full("stts", 0, 0, struct.pack(">III", 1, 90, 3000)), "ctts": full("ctts", 1, 0, struct.pack(">IIiIi", 2, 1, -5, 2, 7)), "stsc": full("stsc", 0, 0, struct.pack(">IIII", 1, 1, 10, 1)),
        "stsz": full("stsz", 0, 0, struct.pack(">II", 0, 90), struct.pack(">90I", *[50000] * 90)), "stss": full("stss", 0, 0, struct.pack(">4I", 3, *SYNC)),
        "stco": full("co64" if wide else "stco", 0, 0, struct.pack(">I", 9), struct.pack(">9Q" if wide else ">9I", *[1000 + i * 500000 for i in range(9)])),
    }
    mdhd = full("mdhd", 0, 0, struct.pack(">IIII", 0, 0, 90000, 270000), struct.pack(">HH", (5 << 10) | (14 << 5) | 7, 0))
    hdlr = full("hdlr", 0, 0, b"\0\0\0\0vide" + b"\0" * 12)
    trak = B.box("trak", B.box("mdia", mdhd, hdlr, B.box("minf", B.box("stbl", *[v for k, v in stbl.items() if k not in drop]))))
    return B.box("ftyp", b"isom", b"\0\0\0\0") + B.box("moov", trak) + struct.pack(">I4sQ", 1, b"mdat", 16 + 20) + b"x" * 20 + struct.pack(">I4s", 0, b"free") + b"rest"


def test_boxes(spark):
    files = spark.createDataFrame([("a", movie()), ("b", None), ("c", b"\0\0\0"), ("d", b"\0\0\0\4bad!")], "path string, content binary")
    rows = B.box_tree(files).collect()
    assert [r.type for r in rows if r.path == "a"][:4] == ["ftyp", "moov", "trak", "mdia"] and {r.path for r in rows} == {"a"}
    by = {r.box_path: r for r in rows}
    assert by["/mdat"].size == 36 and by["/mdat"].header == 16 and by["/mdat"].payload is None and by["/free"].size == 12
    assert by["/moov/trak/mdia/minf/stbl/stts"].depth == 5


def test_tracks_and_samples(spark):
    files = spark.createDataFrame([("a", movie()), ("w", movie(wide=True)), ("x", movie(drop=("stsz",)))], "path string, content binary")
    rows = {r.path: r for r in B.track_table(files).collect()}
    a = rows["a"]
    assert (a.handler, a.timescale, a.duration, a.language, a.sample_count, a.sync) == ("vide", 90000, 270000, "eng", 90, SYNC)
    assert a.chunk_offsets == rows["w"].chunk_offsets and a.chunk_offsets[:2] == [1000, 501000] and rows["x"].error == "missingBox"
    t = B.track_table(files).where("path = 'a'")
    runs = t.select("path", F.posexplode("stts").alias("run", "r")).select("path", "run", "r.count", F.col("r.value").alias("delta"))
    d = media.decode_times(runs, ["path"], "run", "count", "delta")
    offsets = t.select("path", F.posexplode("ctts").alias("run", "r")).select("path", "run", "r.count", F.col("r.value").alias("off"))
    pts = {r.sample: (r.dts, r.pts) for r in media.presentation_times(d, offsets, ["path"], "sample", "dts", "run", "count", "off").collect()}
    assert len(pts) == 90 and pts[0] == (0, -5) and pts[2] == (6000, 6007) and pts[3] == (9000, 9000)
    stsc = t.select("path", F.explode("stsc").alias("r")).select("path", "r.*")
    chunks = media.chunk_runs(stsc, ["path"], "first_chunk", "per_chunk", F.lit(9)).collect()
    assert [(c.chunk, c.samples) for c in sorted(chunks)] == [(i, 10) for i in range(1, 10)]
    s = spark.range(90).select(F.lit("a").alias("path"), F.col("id").alias("sample"), F.lit(50000).alias("size"), F.floor(F.col("id") / 10).alias("chunk")).withColumn("offset", 1000 + F.col("chunk") * 500000)
    o = {r.sample: r.file_offset for r in media.sample_offsets(s, ["path"], "sample", "size", "chunk", "offset").collect()}
    assert o[0] == 1000 and o[9] == 451000 and o[10] == 501000
    n = {r.sample: r.nearest_sync for r in media.nearest_sync(s, ["path"], "sample", (F.col("sample") + 1).isin(SYNC)).collect()}
    assert n[0] == 0 and n[29] == 0 and n[30] == 30 and n[89] == 60


def test_adts(spark):
    good = [B.adts_header(2, 44100, 2, n) + b"p" * n for n in (10, 20, 30)]
    data = b"junk" + good[0] + b"\xff" + good[1] + good[2][:-1]
    rows = B.adts_frames(data)
    assert [(r[1], r[4], r[5]) for r in rows] == [(17, 44100, 2), (27, 44100, 2)]
    df = spark.createDataFrame([("a", data)], "path string, content binary")
    assert B.adts_table(df).count() == 2


def test_nal_units(spark):
    units = [b"\x09\xf0", b"\x67abc", b"\x68d", b"\x65idr", b"\x06sei", b"\x41p", b"\x06tail"]
    data = b"".join((b"\0\0\0\1" if i % 2 else b"\0\0\1") + u for i, u in enumerate(units))
    assert [u[3] for u in B.nal_units(data)] == units
    assert B.to_annex_b(B.to_length_prefixed(data)) == b"".join(b"\0\0\0\1" + u for u in units)
    df = spark.createDataFrame([("a", data)], "path string, content binary")
    got = sorted(B.access_units(B.nal_table(df), "h264").collect())
    assert [(r.nals, r.keyframe) for r in got] == [(4, True), (2, False)]


def test_tags():
    assert B.id3_frames(B.id3_tag([("TIT2", "Title é"), ("TXXX", "a")])) == [("TIT2", "Title é", 10), ("TXXX", "a", 3)]
    assert B.id3_frames(b"nope") == []
    assert B.crc32_mpeg(b"123456789") == 0x0376E6E7
    head = bytes([0xFC, 0x30, 0x20, 0, 0, 0, 0, 0, 0, 0, 0xFF, 0xF0, 0x10])
    assert B.splice_info(head + bytes([0, 0]))[0][0] == "splice_null"
    insert = struct.pack(">IB", 7, 0x7F) + bytes([0xE0]) + bytes([0xFE]) + struct.pack(">I", 900000) + bytes([0xFE]) + struct.pack(">I", 2700000)
    assert B.splice_info(head + bytes([5]) + insert) == [("splice_insert", 7, True, 900000, 2700000, False)]
    assert B.splice_info(head + bytes([6, 0xFF]) + struct.pack(">I", 5)) == [("time_signal", None, None, (1 << 32) | 5, None, None)]
    assert B.splice_info(b"\xfc") == [] and B.splice_info(head + bytes([5, 0])) == []


def test_media_segment():
    data = B.media_segment(3, 1, 9000, [(3000, 0, True, b"aaaa"), (3000, -5, False, b"bb")])
    tree = {b[0]: b for b in B.boxes(data)}
    assert set(tree) >= {"/styp", "/moof", "/moof/mfhd", "/moof/traf/tfhd", "/moof/traf/tfdt", "/moof/traf/trun", "/mdat"}
    offset = struct.unpack_from(">i", tree["/moof/traf/trun"][7], 8)[0]
    assert data[tree["/moof"][4] + offset :] == b"aaaabb"
    assert "/styp" not in {b[0] for b in B.boxes(B.media_segment(3, 1, 0, [(1, 0, True, b"x")], styp=False))}


def test_ttml(spark):
    text = '<tt xml:lang="en"><body><p begin="00:00:01.000" end="00:00:03.000">Hello &amp; <span>you</span><b>!</b></p><p begin="00:00:01:12" end="00:00:02.5">x</p></body></tt>'
    df = spark.createDataFrame([(1, text), (2, "<p>no</p>"), (3, "<tt><p/></tt>"), (4, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.pos): r for r in ttml.cues(df).collect()}
    assert (rows[1, 0].begin, rows[1, 0].end, rows[1, 0].text, rows[1, 0].error) == (1.0, 3.0, "Hello & you", None)
    assert len(rows) == 4 and rows[1, 1].error == "invalidTimecode" and rows[2, None].error == "missingTT" and rows[3, None].error == "missingLanguage"
    back = ttml.cues(ttml.render(ttml.cues(df).where("error is null"))).first()
    assert (back.begin, back.end, back.text) == (1.0, 3.0, "Hello & you")


def test_ttml_is_read_as_xml(spark):
    text = """<?xml version='1.0'?><t:tt xmlns:t='http://www.w3.org/ns/ttml' xmlns:tts='s' xml:lang='de'><t:head><t:styling><t:style xml:id='s1' tts:color='red'/><t:style/></t:styling>
<t:layout><t:region xml:id='r1' tts:origin='10% 80.5%' tts:extent='80% 10%'/><t:region xml:id='r2'/></t:layout></t:head><t:body><!-- <p begin='0:0:0' end='0:0:1'>no</p> --><t:div>
<t:p begin='00:00:01' end='00:00:02' region='r1' style='s1'>&#39;a&quot; &amp;lt; <![CDATA[<b>]]></t:p><t:p begin='00:00:03'>no end</t:p></t:div></t:body></t:tt>"""
    df = spark.createDataFrame([(1, text), (2, "<tt xml:lang='x'><p>"), (3, "no xml")], "doc_id long, text string")
    rows = ttml.cues(df).orderBy("doc_id").collect()
    assert [r.error for r in rows] == [None, "invalidXML", "invalidXML"]
    assert (rows[0].text, rows[0].language, rows[0].region, rows[0].style) == ("'a\" &lt; <b>", "de", "r1", "s1")
    assert [(r.id, r.x, r.y, r.width, r.height) for r in ttml.regions(df).orderBy("pos").collect()] == [("r1", 10.0, 80.5, 80.0, 10.0), ("r2", 0.0, 0.0, 0.0, 0.0)]
    assert [(r.id, r.color, r.font_size) for r in ttml.styles(df).collect()] == [("s1", "red", None)]
    back = ttml.render(ttml.cues(df).where("error is null"), "doc_id", "de", ttml.styles(df), ttml.regions(df))
    assert "10% 80.50%" in back.first().text
    again = ttml.cues(back).first()
    assert (again.text, again.region, again.style, again.begin, again.end) == ("'a\" &lt; <b>", "r1", "s1", 1.0, 2.0)
    assert ttml.styles(back).select("id", "color").collect() == ttml.styles(df).select("id", "color").collect()
    assert ttml.regions(back).drop("pos").orderBy("id").collect() == ttml.regions(df).drop("pos").orderBy("id").collect()


def test_encryption(spark):
    key, iv = bytes(range(16)), (7).to_bytes(16, "big")
    df = spark.createDataFrame([(7, b"payload"), (8, b"")], "seq long, data binary")
    k = F.lit(bytearray(key))
    sealed = crypto.encrypt(df, "data", k, crypto.iv_bytes(F.col("seq")))
    rows = {r.seq: r for r in crypto.decrypt(sealed, "encrypted", k, crypto.iv_bytes(F.col("seq"))).collect()}
    assert bytes(rows[7].decrypted) == b"payload" and bytes(rows[8].decrypted) == b"" and len(rows[7].encrypted) == 16
    # NIST SP 800-38A, CBC-AES128, first block
    k2, iv2 = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    plain, want = bytes.fromhex("6bc1bee22e409f96e93d7e117393172a"), "7649abac8119b246cee98e9b12e9197d"
    r = crypto.encrypt(spark.createDataFrame([(plain,)], "data binary"), "data", F.lit(bytearray(k2)), F.lit(bytearray(iv2))).first()
    assert bytes(r.encrypted)[:16].hex() == want
