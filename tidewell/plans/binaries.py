"""Queries over bytes: files, frames, units, tags and packets are written from the tables and read back.

The SQL works on the tables alone: it never sees a byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media as M
from ..operators import crypto, media, patterns
from ..sources import binary as B
from ..sources import pcm, tags
from ..sources import transport_stream as TS
from ..sources import writers as W
from ..stage import materialize
from .registry import load, query


def order_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(k, x): the lines of each order, in order, as an array of structs."""
    li = load(spark, sf_dir, "lineitem")
    own = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *columns)
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(own)).alias("x"))


#: The same lines in SQL: i from 0 along each order.
LINES = "l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, * FROM lineitem)"


@query("""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, length(s_name) AS l FROM supplier)
SELECT k, '/ftyp' AS box_path, 0 AS depth, 0::BIGINT AS "offset", 8 + n AS size, NULL::BIGINT AS parent FROM s
UNION ALL SELECT k, '/moov', 0, 8 + n, 40 + l, NULL FROM s
UNION ALL SELECT k, '/moov/udta', 1, 16 + n, 24 + l, 8 + n FROM s
UNION ALL SELECT k, '/moov/udta/name', 2, 24 + n, 8 + l, 16 + n FROM s
UNION ALL SELECT k, '/moov/udta/name', 2, 32 + n + l, 8, 16 + n FROM s
UNION ALL SELECT k, '/moov/free', 1, 40 + n + l, 8, 8 + n FROM s
UNION ALL SELECT k, '/mdat', 0, 48 + n + l, 16 + k, NULL FROM s""")
def box_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.41, 2.1.42, 2.1.57, 2.2.56: boxes written and walked: paths, depths, places, sizes, 64-bit sizes."""
    def make(k: int, n: int, name: str) -> bytes:
        inner = B.box("moov", B.box("udta", B.box("name", name.encode()), B.box("name")), B.box("free"))
        wide = (1).to_bytes(4, "big") + b"mdat" + (16 + k).to_bytes(8, "big") + b"x" * k
        return B.box("ftyp", b"\0" * n) + inner + wide

    files = W.written(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name"), ["s_suppkey", "s_nationkey", "s_name"], make)
    t = B.box_tree(files.select(F.col("s_suppkey").alias("k"), "content"), "k")
    return t.select("k", "box_path", "depth", "offset", "size", F.when(F.col("parent") >= 0, F.col("parent")).alias("parent"))


@query(
    """SELECT s_suppkey AS k, 2 + s_suppkey % 3 AS named, s_name AS first, CASE WHEN s_suppkey % 3 > 0 THEN 'n1' ELSE '' END AS second,
  s_suppkey % 3 = 0 AS no_meta FROM supplier"""
)
def box_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.43–2.1.45: the first child and all children of a kind, and a box by its path."""
    def make(k: int, name: str) -> bytes:
        names = [B.box("name", name.encode())] + [B.box("name", f"n{i + 1}".encode()) for i in range(k % 3)] + [B.box("name")]
        return B.box("moov", B.box("udta", *names), *([B.box("meta", b"\0" * 4)] if k % 3 else []))

    files = W.written(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey", "s_name"], make)
    t = B.box_tree(files.select(F.col("s_suppkey").alias("k"), "content"), "k")
    udta = t.where("box_path = '/moov/udta'").select("k", F.col("offset").alias("at"))
    children = t.where("type = 'name'").join(udta, "k").where("parent = at")
    all_of = children.groupBy("k").agg(F.count("*").alias("named"), F.array_sort(F.collect_list(F.struct("offset", "payload"))).alias("c"))
    path = t.groupBy("k").agg(F.count_if(F.col("box_path") == "/moov/meta").alias("m"))
    text = lambda i: F.get("c", F.lit(i))["payload"].cast("string")
    return all_of.join(path, "k").select("k", "named", text(0).alias("first"), text(1).alias("second"), (F.col("m") == 0).alias("no_meta"))


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, content): a track an order: durations are quantities, sizes part keys, offsets line numbers; chunks of two."""
    def make(k: int, x: list[dict]) -> bytes:
        sizes = [r["l_partkey"] + 1 for r in x]
        chunks, at = [], 1000
        for i in range(0, len(x), 2):
            chunks.append((at, len(x[i : i + 2])))
            at += sum(sizes[i : i + 2]) + 50
        sync = [i + 1 for i, r in enumerate(x) if r["l_returnflag"] == "R"] if k % 3 else None
        tables = W.sample_tables(
            [int(r["l_quantity"]) for r in x], sizes, chunks, [r["l_linenumber"] - 4 for r in x] if k % 2 else None, sync, k % 5 == 0
        )
        return W.movie("vide" if k % 2 else "soun", 600 + k % 7, "abc" if k % 4 else "xyz", tables, int(sum(r["l_quantity"] for r in x)))

    return W.written(order_lines(spark, sf_dir, "l_quantity", "l_returnflag"), ["k", "x"], make).select("k", "content")


@query(f"""WITH {LINES} SELECT k, CASE WHEN k % 2 = 1 THEN 'vide' ELSE 'soun' END AS handler, (600 + k % 7)::BIGINT AS timescale,
  sum(l_quantity)::BIGINT AS duration, CASE WHEN k % 4 > 0 THEN 'abc' ELSE 'xyz' END AS language, count(*) AS samples, (count(*) + 1) // 2 AS chunks,
  string_agg((l_partkey + 1)::VARCHAR, ' ' ORDER BY i) AS sizes, CASE WHEN k % 3 > 0 THEN coalesce(string_agg(CASE
  WHEN l_returnflag = 'R' THEN (i + 1)::VARCHAR END, ' ' ORDER BY i), '') END AS sync FROM l GROUP BY k""")
def track_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.46–2.1.49, 2.1.53–2.1.56, 2.5.24: tracks of files: handler, clock, language, sizes, chunks, sync samples."""
    t = B.track_table(movies(spark, sf_dir), "k")
    sizes = F.when(
        F.col("uniform_size") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("sample_count")), lambda _: F.col("uniform_size"))
    ).otherwise(F.col("sizes"))
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return t.select(
        "k", "handler", "timescale", "duration", "language", F.col("sample_count").alias("samples"),
        F.size("chunk_offsets").cast("long").alias("chunks"), joined(sizes).alias("sizes"), joined(F.col("sync")).alias("sync")
    )


@query(f"""WITH {LINES}, d AS (SELECT k, i, sum(l_quantity::BIGINT) OVER (PARTITION BY k ORDER BY i) - l_quantity::BIGINT AS dts,
  l_quantity::BIGINT AS delta, l_partkey + 1 AS size, i // 2 + 1 AS chunk, l_linenumber, sum(l_partkey + 1) OVER (PARTITION BY k
  ORDER BY i) - l_partkey - 1 AS before FROM l)
SELECT k, i AS sample, dts::BIGINT AS dts, delta, (dts + CASE WHEN k % 2 = 1 THEN l_linenumber - 4 ELSE 0 END)::BIGINT AS pts, size, chunk,
  (1000 + 50 * (chunk - 1) + before)::BIGINT AS file_offset FROM d""")
def sample_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.50–2.1.52, 2.6.9–2.6.15: run lengths of files read and expanded to samples: times, sizes, chunks, places in the file."""
    # each table below reads the tracks: written once, or every file is made and parsed again for each of them
    t = materialize(B.track_table(movies(spark, sf_dir), "k"), "tracks")
    runs = lambda c: t.select("k", F.posexplode(c).alias("run", "r")).select("k", "run", "r.*")
    d = media.decode_times(runs("stts"), ["k"], "run", "count", "value")
    s = media.presentation_times(d, runs("ctts"), ["k"], "sample", "dts", "run", "count", "value")
    sizes = F.when(
        F.col("uniform_size") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("sample_count")), lambda _: F.col("uniform_size"))
    ).otherwise(F.col("sizes"))
    size = t.select("k", F.posexplode(sizes).alias("sample", "size")).withColumn("sample", F.col("sample").cast("long"))
    stsc = t.select("k", F.size("chunk_offsets").alias("n"), F.explode("stsc").alias("r")).select("k", "n", "r.*")
    chunks = media.chunk_runs(stsc, ["k"], "first_chunk", "per_chunk", F.col("n"))
    firsts = patterns.running_sum(chunks, ["k"], "chunk", F.col("samples"), "first")
    place = firsts.select("k", "chunk", F.explode(F.sequence("first", F.col("first") + F.col("samples") - 1)).alias("sample"))
    offset = t.select("k", F.posexplode("chunk_offsets").alias("c", "offset")).select("k", (F.col("c") + 1).cast("long").alias("chunk"), "offset")
    rows = s.join(size, ["k", "sample"]).join(place, ["k", "sample"]).join(offset, ["k", "chunk"])
    return media.sample_offsets(rows, ["k"], "sample", "size", "chunk", "offset").select(
        "k", "sample", "dts", "delta", "pts", "size", "chunk", "file_offset"
    )


RATES = "CASE l_linenumber % 3 WHEN 0 THEN 44100 WHEN 1 THEN 48000 ELSE 16000 END"


@query(
    f"""WITH {LINES} SELECT k, (3 + sum(l_partkey % 900 + 7) OVER (PARTITION BY k ORDER BY i) - (l_partkey % 900 + 7))::BIGINT AS "offset",
  l_partkey % 900 + 7 AS length, {RATES} AS sample_rate, 1 + l_suppkey % 2 AS channels FROM l"""
)
def adts_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.58, 2.9.72: AAC frames written with their headers behind three bytes of damage, and found again."""
    rates = (44100, 48000, 16000)
    def make(x: list[dict]) -> bytes:  # noqa: E306
        frames = [
            B.adts_header(2, rates[r["l_linenumber"] % 3], 1 + r["l_suppkey"] % 2, r["l_partkey"] % 900) + b"\0" * (r["l_partkey"] % 900)
            for r in x
        ]
        return b"bad" + b"".join(frames)

    files = W.written(order_lines(spark, sf_dir), ["x"], make).select("k", "content")
    return B.adts_table(files, "k").select(
        "k", "offset", F.col("length").cast("long").alias("length"), "sample_rate", F.col("channels").cast("long").alias("channels")
    )


UNITS = "CASE WHEN k % 2 = 0 THEN CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN 1 ELSE 6 END ELSE CASE l_returnflag WHEN 'R' THEN 19 WHEN 'A' THEN 1 ELSE 32 END END"


def unit_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, hevc, content): a unit a line; even orders H.264, odd ones HEVC; start codes of three and four bytes."""
    kinds = {False: {"R": 5, "A": 1}, True: {"R": 19, "A": 1}}

    def make(k: int, x: list[dict]) -> bytes:
        out, hevc = [], k % 2 == 1
        for i, r in enumerate(x):
            kind = kinds[hevc].get(r["l_returnflag"], 32 if hevc else 6)
            out.append(b"\0\0\0\1"[i % 2 :] + (bytes([kind << 1, 1]) if hevc else bytes([0x60 | kind])) + b"u" * (r["l_partkey"] % 50))
        return b"".join(out)

    rows = W.written(order_lines(spark, sf_dir, "l_returnflag"), ["k", "x"], make)
    return rows.select("k", (F.col("k") % 2 == 1).alias("hevc"), "content")


@query(
    f"""WITH {LINES} SELECT k, i AS position, ({UNITS})::INT AS nal_type, (l_partkey % 50 + CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END)::BIGINT AS bytes,
  l_returnflag <> 'N' AS is_picture, l_returnflag = 'R' AS is_key, CASE WHEN k % 2 = 1 THEN l_returnflag = 'N' ELSE false END AS is_parameters
  FROM l"""
)
def nal_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.59, 2.1.60, 2.1.62–2.1.66: units between start codes of two codecs, their kinds, pictures and parameter sets."""
    s = unit_streams(spark, sf_dir)
    rows = B.nal_table(s.where("not hevc"), False, "k").withColumn("codec", F.lit("h264")).union(
        B.nal_table(s.where("hevc"), True, "k").withColumn("codec", F.lit("h265"))
    )
    first = F.conv(F.hex(F.substr("unit", F.lit(1), F.lit(1))), 16, 10).cast("int")
    kind = F.when(F.col("codec") == "h265", M.hevc_nal_type(first)).otherwise(F.col("nal_type"))
    sets = (F.col("codec") == "h265") & F.col("nal_type").between(32, 34)
    return rows.select(
        "k", F.col("position").cast("long").alias("position"), kind.alias("nal_type"), F.octet_length("unit").cast("long").alias("bytes"),
        M.is_vcl(F.col("codec"), F.col("nal_type")).alias("is_picture"), M.is_keyframe(F.col("codec"), F.col("nal_type")).alias("is_key"),
        sets.alias("is_parameters")
    )


@query(f"""WITH {LINES}, g AS (SELECT *, coalesce(sum((l_returnflag <> 'N')::INT) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS unit FROM l WHERE k % 2 = 0)
SELECT k, unit::BIGINT AS access_unit, count(*) AS nals, bool_or(l_returnflag = 'R') AS keyframe FROM g GROUP BY 1,
  2 HAVING bool_or(l_returnflag <> 'N')""")
def access_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.61: units grouped by the picture that closes them."""
    s = unit_streams(spark, sf_dir).where("not hevc")
    return B.access_units(B.nal_table(s, False, "k"), "h264", "k")


@query(
    f"""WITH {LINES} SELECT k, sum(4 + 1 + l_partkey % 50)::BIGINT AS prefixed_bytes, count(*) AS units,
  sum(4 + 1 + l_partkey % 50)::BIGINT AS annex_b_bytes, count(*) AS units_again FROM l WHERE k % 2 = 0 GROUP BY 1"""
)
def unit_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.73, 2.9.74: start codes to lengths and back, all codes of four bytes then."""
    s = unit_streams(spark, sf_dir).where("not hevc").select("k", "content")
    p = W.written(W.written(s, ["content"], B.to_length_prefixed, "prefixed"), ["prefixed"], B.to_annex_b, "again")
    n = lambda c: B.nal_table(p.select("k", F.col(c).alias("content")), False, "k").groupBy("k").agg(F.count("*").alias("n"))
    a, b = n("content").withColumnRenamed("n", "units"), n("again").withColumnRenamed("n", "units_again")
    sizes = p.select(
        "k", F.octet_length("prefixed").cast("long").alias("prefixed_bytes"), F.octet_length("again").cast("long").alias("annex_b_bytes")
    )
    return sizes.join(a, "k").join(b, "k")


@query(
    """SELECT p_partkey AS k, (p_size % 32)::INT AS profile, (p_size % 2)::INT AS tier, (30 + p_size)::INT AS level, (p_size % 4)::INT AS chroma,
  (16 * p_size)::INT AS width, (9 * p_size)::INT AS height FROM part"""
)
def parameter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.67: sequence parameter sets of HEVC, made bit by bit, and what they say."""
    def make(z: int) -> bytes:
        bits: list[str] = []
        put = lambda v, n: bits.append(format(v, f"0{n}b"))
        golomb = lambda v: bits.append("0" * ((v + 1).bit_length() - 1) + format(v + 1, "b"))
        for v, n in ((0, 4), (0, 3), (1, 1), (0, 2), (z % 2, 1), (z % 32, 5), (1 << 30, 32), (5, 48), (30 + z, 8)):
            put(v, n)
        for v in (0, z % 4):
            golomb(v)
        if z % 4 == 3:
            put(0, 1)
        golomb(16 * z)
        golomb(9 * z)
        text = "".join(bits) + "1"
        text += "0" * (-len(text) % 8)
        raw = bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))
        out = bytearray(b"\x42\x01")
        zeros = 0
        for b in raw:  # bytes that would look like a start code get a 3 before them
            if zeros >= 2 and b <= 3:
                out.append(3)
                zeros = 0
            out.append(b)
            zeros = zeros + 1 if b == 0 else 0
        return bytes(out)

    files = W.written(load(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_size"], make)
    fields = ("profile", "tier", "level", "chroma", "width", "height")
    return B.rows_of(
        files.withColumnRenamed("p_partkey", "k"), "k", "content", ", ".join(f"{f} int" for f in fields),
        lambda d: [tuple(W.hevc_profile(d)[f] for f in fields)]
    )


@query(
    """SELECT c_custkey AS k, 'TIT2' AS frame_id, c_name AS text, length(c_name) + 2 AS size FROM customer UNION ALL SELECT c_custkey, 'TPE1',
  repeat(c_mktsegment, 20), length(c_mktsegment) * 20 + 2 FROM customer WHERE c_custkey % 2 = 0"""
)
def id3_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.72, 2.2.76: tags of one and two frames, synchsafe sizes."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    files = W.written(
        c, ["c_custkey", "c_name", "c_mktsegment"], lambda k, a, b: B.id3_tag([("TIT2", a), *([("TPE1", b * 20)] if k % 2 == 0 else [])])
    )
    return B.rows_of(
        files.withColumnRenamed("c_custkey", "k"), "k", "content", B.ID3, B.id3_frames
    ).select("k", "frame_id", "text", F.col("size").cast("long").alias("size"))


@query(
    f"""WITH {LINES} SELECT k, CASE WHEN l_returnflag = 'A' THEN 257 ELSE 256 END AS pid, 9000 * (i + 1) + k AS pts, CASE WHEN l_returnflag <> 'A'
  AND l_linenumber % 2 = 0 THEN 9000 * (i + 1) + k - 100 END AS dts, true AS continuous, l_partkey % 700 + 1 AS bytes FROM l"""
)
def transport_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.64–2.2.70: transport segments of video and audio: tables, packets, headers with both times, read back."""
    def make(k: int, x: list[dict]) -> bytes:
        out = []
        for i, r in enumerate(x):
            audio, t = r["l_returnflag"] == "A", 9000 * (i + 1) + k
            dts = t - 100 if not audio and r["l_linenumber"] % 2 == 0 else None
            out.append((TS.AUDIO if audio else TS.VIDEO, t, dts, r["l_returnflag"] == "R", b"f" * (r["l_partkey"] % 700 + 1)))
        return TS.segment(out)

    files = W.written(order_lines(spark, sf_dir, "l_returnflag"), ["k", "x"], make).select("k", "content")
    u = TS.unit_table(files, "k")
    return u.select("k", F.col("pid"), "pts", "dts", "continuous", F.octet_length("payload").cast("long").alias("bytes"))


@query("""WITH RECURSIVE b AS (SELECT n_nationkey AS k, n_name AS s, 0 AS i, 4294967295::UBIGINT AS crc FROM nation
  UNION ALL SELECT k, s, i + 1, CASE WHEN (crc >> 31) & 1 <> (ascii(s[i // 8 + 1]) >> (7 - i % 8)) & 1 THEN xor((crc << 1) & 4294967295::UBIGINT,
  79764919::UBIGINT) ELSE (crc << 1) & 4294967295::UBIGINT END FROM b WHERE i < 8 * length(s))
SELECT k, crc::BIGINT AS crc FROM b WHERE i = 8 * length(s)""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.71: CRC-32/MPEG-2 of names."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").cast("binary").alias("content"))
    return B.rows_of(n.withColumnRenamed("n_nationkey", "k"), "k", "content", "crc long", lambda d: [(B.crc32_mpeg(d),)])


TREES = {
    "video": "ftyp moov mvhd trak tkhd mdia mdhd hdlr minf vmhd dinf dref stbl stsd stts stsc stsz stco mvex trex",
    "audio": "ftyp moov mvhd trak tkhd mdia mdhd hdlr minf smhd dinf dref stbl stsd stts stsc stsz stco mvex trex",
    "text": "ftyp moov mvhd trak tkhd mdia mdhd hdlr minf sthd dinf dref stbl stsd stts stsc stsz stco mvex trex",
}


@query("SELECT s_suppkey AS k, CASE s_suppkey % 3 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TREES.values())) + """ END AS boxes,
  CASE s_suppkey % 3 WHEN 0 THEN 'vide' WHEN 1 THEN 'soun' ELSE 'subt' END AS handler,
  (1000 * (s_nationkey + 1))::BIGINT AS timescale, CASE WHEN s_suppkey % 2 = 0 THEN 'eng' ELSE 'und' END AS language, CASE s_suppkey % 3
  WHEN 0 THEN 'avc1' WHEN 1 THEN 'mp4a' ELSE 'stpp' END AS entry FROM supplier""")
def init_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.57, 2.2.60, 2.2.61, 2.2.71: init segments of video, audio and text tracks, their boxes and headers."""
    kinds = tuple(TREES)

    def make(k: int, n: int) -> bytes:
        track = {"id": 1, "kind": kinds[k % 3], "timescale": 1000 * (n + 1), "language": "eng" if k % 2 == 0 else "und"}
        return W.init_segment([track | ({"width": 640, "height": 360} if k % 3 == 0 else {})])

    files = W.written(
        load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), ["s_suppkey", "s_nationkey"], make
    ).select(F.col("s_suppkey").alias("k"), "content")
    tree = B.box_tree(files, "k")
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "type"))), lambda x: x["type"]), " ")
    entry = F.max(F.when(F.col("type") == "stsd", F.substr("payload", F.lit(13), F.lit(4)).cast("string")))
    return tree.groupBy("k").agg(order.alias("boxes"), entry.alias("entry")).join(
        B.track_table(files, "k").select("k", "handler", "timescale", "language"), "k"
    )


@query(f"""WITH {LINES}, t AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END AS track, sum(l_quantity::BIGINT) OVER (PARTITION BY k,
  l_returnflag = 'A' ORDER BY i) - l_quantity::BIGINT AS before, row_number() OVER (PARTITION BY k, l_returnflag = 'A' ORDER BY i) - 1 AS n FROM l)
SELECT k, k + 1 AS sequence, track::BIGINT AS track, n::INT AS sample, (k * 10 + before)::BIGINT AS time, l_quantity::BIGINT AS duration,
  (l_linenumber - 3)::BIGINT AS composition, l_linestatus = 'O' AS sync, l_partkey || '/' || l_suppkey AS payload FROM t""")
def media_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.58, 2.2.59, 2.2.62, 2.2.63: media segments of one and two tracks; partial ones (even orders) have no segment type."""
    def make(k: int, x: list[dict]) -> bytes:
        tracks = []
        for number, audio in ((1, False), (2, True)):
            own = [r for r in x if (r["l_returnflag"] == "A") == audio]
            samples = [
                (int(r["l_quantity"]), r["l_linenumber"] - 3, r["l_linestatus"] == "O", f"{r['l_partkey']}/{r['l_suppkey']}".encode())
                for r in own
            ]
            if samples:
                tracks.append((number, k * 10, samples))
        return B.muxed_segment(k + 1, tracks, styp=k % 2 == 1)

    files = W.written(order_lines(spark, sf_dir, "l_quantity", "l_returnflag", "l_linestatus"), ["k", "x"], make).select("k", "content")
    return B.fragment_table(files, "k").withColumn("payload", F.col("payload").cast("string"))


@query(
    """SELECT event_id, '0x' || lower(printf('%08x', 46 + length(event_type))) || '656d7367' || '01000000' || '00015f90' || printf('%016x',
  trunc(value * 90000)::BIGINT) || '00000000' || printf('%08x', event_id) || lower(hex('https://id3')) || '00' || lower(hex('v')) || '00'
  || lower(hex(event_type)) AS bytes FROM events"""
)
def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.77: event messages, byte by byte."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", M.pts(F.col("value")).alias("t"))
    made = W.written(e, ["event_id", "event_type", "t"], lambda i, k, t: W.emsg("https://id3", "v", 90000, t, 0, i, k.encode()))
    return made.select("event_id", F.concat(F.lit("0x"), F.lower(F.hex("content"))).alias("bytes"))


@query(
    f"""WITH {LINES} SELECT k, count(*) FILTER (WHERE l_returnflag = 'R' AND l_partkey % 300 > 48) AS protected_units, sum(CASE
  WHEN l_returnflag = 'R' AND l_partkey % 300 > 48 THEN (l_partkey % 300 - 32) // 16 * 16 ELSE 0 END)::BIGINT AS protected_bytes, true AS round_trip,
  true AS same_size FROM l GROUP BY 1"""
)
def sample_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.68, 2.9.69: pictures and frames encrypted in part, and decrypted again."""
    def make(x: list[dict]) -> bytes:
        return b"".join(b"\0\0\0\1" + bytes([0x65 if r["l_returnflag"] == "R" else 0x66]) + b"\x55" * (r["l_partkey"] % 300) for r in x)

    key, iv = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f")), F.unhex(F.lit("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff"))
    files = W.written(order_lines(spark, sf_dir, "l_returnflag"), ["x"], make).select("k", "content")
    pieces = B.rows_of(files, "k", "content", "position int, piece binary, protected boolean", lambda d: B.protected_pieces(d, "video"))
    counts = pieces.groupBy("k").agg(
        F.count_if("protected").alias("protected_units"),
        F.sum(F.when(F.col("protected"), F.octet_length("piece")).otherwise(0)).cast("long").alias("protected_bytes")
    )
    sealed = crypto.sample_crypt(files, "video", key, iv, False, "k")
    back = crypto.sample_crypt(sealed.withColumnRenamed("crypted", "content"), "video", key, iv, True, "k")
    both = files.join(sealed, "k").join(back.withColumnRenamed("crypted", "back"), "k").join(counts, "k")
    changed = (F.col("crypted") != F.col("content")) == (F.col("protected_units") > 0)
    return both.select(
        "k", "protected_units", "protected_bytes", ((F.col("back") == F.col("content")) & changed).alias("round_trip"),
        (F.octet_length("crypted") == F.octet_length("content")).alias("same_size")
    )


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, list_transform(e,
  lambda x: trunc(greatest(-1, least(1, x)) * 32767)::BIGINT) AS h FROM v)
SELECT vec_id, array_to_string(list_concat(list_transform(range(1, len(h) + 1, 2), lambda i: h[i] * 65536), list_transform(range(2, len(h) + 1, 2),
  lambda i: h[i] * 65536)), ' ') AS planar FROM s""")
def pcm_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.50, 2.1.76: interleaved big-endian 16-bit bytes to planar little-endian 32-bit ones, in one pass."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", M.float_to_int16(F.col("embedding")).alias("h"))
    raw = W.written(v, ["h"], lambda h: pcm.pack(h, pcm.Format("int16", 2, big_endian=True)))
    out = W.written(
        raw.select("vec_id", "content"), ["content"],
        lambda d: pcm.convert(d, pcm.Format("int16", 2, big_endian=True), pcm.Format("int32", 2, planar=True)), "done"
    )
    return B.rows_of(out, "vec_id", "done", "planar string", lambda d: [(" ".join(map(str, pcm.unpack(d, pcm.Format("int32", 2, planar=True)))),)])


@query(
    """SELECT event_id, 'splice-' || event_id AS id, 'TYPE' AS class, CASE WHEN event_id % 2 = 0 THEN 30.0::DOUBLE END AS duration, '0xFC' AS cmd
  FROM events WHERE event_id % 10 = 0"""
)
def splice_date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.71, 2.9.80, 2.2.13: splice attributes go out with date ranges and are scanned again."""
    from ..sources import manifest as S

    i = F.col("event_id")
    e = load(spark, sf_dir, "events").where(i % 10 == 0).select("event_id", "ts")
    s = W.written(e.select("event_id", "ts"), ["event_id"], lambda k: W.splice_section("time_signal", pts=k), "section")
    attributes = tags.splice_attributes(F.col("section"), i % 2 == 0)
    r = s.select(
        "event_id", F.concat(F.lit("splice-"), i.cast("string")).alias("id"), F.lit("TYPE").alias("class"),
        F.col("ts").cast("timestamp").alias("start_date"), F.lit(None).cast("timestamp").alias("end_date"),
        F.when(i % 2 == 0, 30.0).alias("duration"), F.lit(None).cast("double").alias("planned_duration"),
        F.lit(False).alias("end_on_next"), attributes.alias("client")
    )
    text = F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform(F.split(tags.date_range_line(), "\n"), lambda x: x), "\n"))
    lines = S.lines(r.select(i.alias("doc_id"), text.alias("text")))
    d = S.date_ranges(lines)
    cmd = S.tagged(lines, "#EXT-X-DATERANGE").select(
        "doc_id", F.substr(F.try_element_at("attrs", F.lit("SCTE35-CMD")), F.lit(1), F.lit(4)).alias("cmd")
    )
    return d.join(cmd, "doc_id").select(F.col("doc_id").alias("event_id"), "id", "class", "duration", "cmd")
