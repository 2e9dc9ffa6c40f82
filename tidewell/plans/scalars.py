"""Queries over scalar rules: PCM widths and layouts, clocks, names and texts, probes, keys, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import media as M
from ..functions import text as T
from ..operators import ladders, pipeline, rules
from ..sources import probe
from ..sources.writers import pssh_hex
from .registry import load, query


def checksum(a: Column) -> Column:
    """Sum of an array's values times their places, from 1."""
    return F.aggregate(
        F.transform(a, lambda x, i: x.cast("decimal(38,6)") * (i + 1)), F.lit(0).cast("decimal(38,6)"),
        lambda s, x: (s + x).cast("decimal(38,6)")
    ).cast("double")


SUM = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * i))::DOUBLE"


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT vec_id, e, list_transform(e, lambda x: trunc(greatest(-1, least(1, x)) * 32767)::BIGINT) AS h,
  list_transform(e, lambda x: trunc(greatest(-1, least(1, x)) * 2147483647.0)::BIGINT) AS w FROM v),
t AS (SELECT *, list_transform(h, lambda x: x * 65536) AS up FROM s)
SELECT vec_id, {SUM.format('up')} AS widened, {SUM.format('h')} AS narrowed, {SUM.format('w')} AS from_float,
  round(list_sum(list_transform(w, lambda x: x / 2147483648.0)), 6) AS to_float, {SUM.format('h')} AS woven FROM t""")
def pcm_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.43–2.9.46, 2.9.48: 16 to 32 bits and back, float to 32 bits and back, planes woven again."""
    v = load(spark, sf_dir, "embeddings").select(
        "vec_id", M.float_to_int16(F.col("embedding")).alias("h"), M.float_to_int32(F.col("embedding")).alias("w")
    )
    v = v.withColumn("up", M.int16_to_int32(F.col("h"))).withColumn("planes", M.deinterleave(F.col("h"), 2))
    total = F.aggregate(M.int32_to_float(F.col("w")), F.lit(0.0), lambda s, x: s + x)
    return v.select(
        "vec_id", checksum(F.col("up")).alias("widened"), checksum(M.int32_to_int16(F.col("up"))).alias("narrowed"),
        checksum(F.col("w")).alias("from_float"),
        F.round(total, 6).alias("to_float"), checksum(M.interleave(F.col("planes"))).alias("woven"),
    )


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, round(list_sum(e) * 2, 6) AS doubled, round(list_sum(e) * 2 * sqrt(0.5), 6) AS equal_power,
  round(list_sum(list_transform(range(0, len(e) // 8), lambda f: greatest(-1, least(1, e[8*f+1] + (e[8*f+3] + e[8*f+5] + e[8*f+7]) * sqrt(0.5))))),
  6) AS left_side,
  round(list_sum(list_transform(range(0, len(e) // 8), lambda f: greatest(-1, least(1, e[8*f+2] + (e[8*f+3] + e[8*f+6] + e[8*f+8]) * sqrt(0.5))))),
  6) AS right_side FROM v""")
def channel_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.55, 2.9.58: mono to stereo in both laws, 7.1 to stereo."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = load(spark, sf_dir, "embeddings").select(
        "vec_id", M.mono_to_stereo(e).alias("a"), M.mono_to_stereo(e, True).alias("b"), M.mix(F.col("embedding"), M.SURROUND_71).alias("c")
    )
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    side = lambda k: F.filter("c", lambda _, i: i % 2 == k)
    return v.select(
        "vec_id", total("a").alias("doubled"), total("b").alias("equal_power"), total(side(0)).alias("left_side"),
        total(side(1)).alias("right_side")
    )


@query("""SELECT c_custkey, array_to_string(list_transform(range(0, 9), lambda i: c_name[2*i+2] || c_name[2*i+1]), '') AS pairs_swapped,
  array_to_string(list_transform(range(0, 4), lambda i: c_name[4*i+4] || c_name[4*i+3] || c_name[4*i+2] || c_name[4*i+1]), '') AS fours_swapped,
  c_custkey * 7 // 4 AS frames, (c_custkey * 7 // 4) / 44100.0::DOUBLE AS seconds, trunc(c_acctbal * 44100)::BIGINT * 4 AS bytes FROM customer""")
def byte_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.49, 2.9.51–2.9.53, 2.9.35, 2.9.36: bytes swapped, sizes to frames and seconds and back."""
    c, size = load(spark, sf_dir, "customer"), F.col("c_custkey") * 7
    raw = F.col("c_name").cast("binary")
    return c.select(
        "c_custkey", M.byte_swap(raw, 2).cast("string").alias("pairs_swapped"),
        M.byte_swap(F.substr(raw, F.lit(1), F.lit(16)), 4).cast("string").alias("fours_swapped"),
        M.frames_in(size, 2, 2).alias("frames"), M.seconds_in(size, 2, 2, 44100).alias("seconds"),
        M.bytes_for(F.col("c_acctbal"), 2, 2, 44100).alias("bytes"),
    )


@query("""WITH e AS (SELECT event_id, value, event_id % 3000 - 100 AS v, CASE event_id % 3 WHEN 0 THEN 90000 WHEN 1 THEN 48000 ELSE 600 END AS ts
  FROM events)
SELECT event_id, CASE WHEN v <= 0 THEN 0 ELSE v * 44100 // ts END::BIGINT AS rescaled, CASE WHEN v <= 0 THEN 0
  ELSE v * 1000 // ts END::BIGINT AS milliseconds, trunc(value * ts)::BIGINT AS ticks,
  trunc(value * 90000)::BIGINT AS pts, v / ts::DOUBLE < value AS before, CASE WHEN value > 20 THEN 3600 / value ELSE CASE
  WHEN value > 0 THEN 3600 / value ELSE 0 END END AS speed,
  CASE WHEN event_id % 4 = 0 THEN 0.8 ELSE 0.3 + 0.5 * (event_id % 4) / 4 END::DOUBLE AS progress FROM e""")
def media_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.32–2.9.34, 2.7.7, 2.5.16, 2.11.10: times between clocks, compared in seconds; speed and progress of jobs."""
    i = F.col("event_id")
    e = load(spark, sf_dir, "events").withColumn("v", i % 3000 - 100).withColumn(
        "ts", F.when(i % 3 == 0, 90000).when(i % 3 == 1, 48000).otherwise(600)
    )
    v, ts, value = F.col("v"), F.col("ts"), F.col("value")
    return e.select(
        "event_id", M.rescale(v, ts, F.lit(44100)).alias("rescaled"), M.rescale(v, ts, F.lit(1000)).alias("milliseconds"),
        M.ticks(value, ts).alias("ticks"), M.pts(value).alias("pts"),
        (v / ts < value).alias("before"), pipeline.speed_factor(F.lit(3600.0), value).alias("speed"),
        pipeline.poll_progress(F.when(i % 4 == 0, "completed").otherwise("running"), (i % 4) / 4).alias("progress"),
    )


CLOCK = "printf('%02d:%02d.%03d', ms // 60000 % 60, ms // 1000 % 60, ms % 1000)"


@query(f"""WITH e AS (SELECT event_id, user_id, event_type AS k, event_id * 2250 AS ms FROM events)
SELECT event_id, CASE WHEN ms < 3600000 THEN {CLOCK} ELSE printf('%02d:', ms // 3600000) || {CLOCK} END AS short_time,
  'u' || user_id || '/' || event_id || '.3.mp4' AS filled, 'seg_' || event_id || '_%d.ts' AS file, CASE WHEN event_id % 3 = 0 THEN 'ts'
  ELSE 'm4s' END AS extension,
  CASE event_id % 4 WHEN 0 THEN 'a/stereo_' || event_id || '.m3u8' WHEN 1 THEN 'x-stereo' WHEN 2 THEN 'v' || event_id || '_stereo.m3u8'
  ELSE 'plain_stereo' END AS fallback,
  CASE event_id % 5 WHEN 0 THEN 'Rotate every segment' WHEN 1 THEN 'Rotate every ' || user_id || ' seconds' WHEN 2 THEN 'Rotate every ' || user_id
  || ' segments' WHEN 3 THEN 'Manual rotation' ELSE 'No rotation' END AS policy,
  CASE WHEN event_id % 2 = 0 THEN (3600 + user_id + 12.5)::DOUBLE END AS progress, event_id % 3 = 1 AS is_file FROM e""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.11, 2.9.15–2.9.18, 2.9.26, 2.1.80, 2.1.81: short times, templates, names, fallbacks, policies, progress lines."""
    e, i, u = load(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    i_text, u_text = i.cast("string"), u.cast("string")
    by4 = F.when(
        i % 4 == 0, F.concat(F.lit("a/atmos_"), i_text, F.lit(".m3u8"))
    ).when(i % 4 == 1, "x-spatial").when(i % 4 == 2, F.concat(F.lit("v"), i_text, F.lit(".m3u8"))).otherwise("plain")
    kinds = F.element_at(F.array(*map(F.lit, ("everySegment", "interval", "everyNSegments", "manual", "none"))), (i % 5 + 1).cast("int"))
    seconds = F.format_string("%02d:%05.2f", F.floor(u / 60).cast("long"), u % 60 + 12.5)
    line = F.when(
        i % 2 == 0,
        F.concat(
            F.lit("frame= 7 time="),
            F.format_string(
                "%02d:%02d:%05.2f", F.floor((u + 3612.5) / 3600).cast("long"), (F.floor((u + 3612.5) / 60) % 60).cast("long"),
                (u + 3612.5) % 60
            ),
            F.lit(" speed=1x")
        )
    ).otherwise(seconds)
    name = F.when(i % 3 == 0, F.lit("plain")).when(i % 3 == 1, F.lit("a.mp4")).otherwise("b.c.m4s")
    return e.select(
        "event_id", T.vtt_time(i * 2.25, True).alias("short_time"),
        T.fill_template(
            F.concat(F.lit("u"), u_text, F.lit("/{segment}.{part}.{ext}")), i, F.lit(3), F.lit("mp4")
        ).alias("filled"), T.file_name(F.lit("seg_%d_%d.ts"), i).alias("file"),
        F.when(i % 3 == 0, T.file_extension(name)).otherwise(T.file_extension(F.lit("b.c.m4s"))).alias("extension"),
        pipeline.fallback_uri(by4).alias("fallback"), pipeline.describe_policy(kinds, u).alias("policy"),
        probe.progress_seconds(line).alias("progress"), F.coalesce(probe.is_container(name), F.lit(False)).alias("is_file"),
    )


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS duration, s_suppkey % 3 <> 0 AS has_video,
  s_suppkey % 2 = 0 AS has_audio, CASE WHEN s_suppkey % 3 <> 0 THEN (640 + s_suppkey)::INT END AS width,
  CASE WHEN s_suppkey % 3 = 1 THEN 30000.0::DOUBLE / 1001 WHEN s_suppkey % 3 = 2 THEN 25.0 END AS frame_rate, CASE
  WHEN s_suppkey % 2 = 0 THEN 48000.0::DOUBLE END AS sample_rate, s_suppkey % 7 = 0 AS broken FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, NULL, NULL, true FROM supplier WHERE s_suppkey % 7 = 0""")
def probe_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.78, 2.1.79: a probe's JSON with and without streams, and what is none."""
    k = F.col("s_suppkey")
    rate = F.when(k % 3 == 1, "30000/1001").otherwise("25")
    video = F.concat(
        F.lit('{"codec_type":"video","codec_name":"h264","width":'), (k + 640).cast("string"), F.lit(',"height":360,"r_frame_rate":"'),
        rate, F.lit('"}')
    )
    audio = F.lit('{"codec_type":"audio","codec_name":"aac","sample_rate":"48000","channels":2}')
    streams = F.array_join(F.array_compact(F.array(F.when(k % 3 != 0, video), F.when(k % 2 == 0, audio))), ",")
    length = F.when(k % 5 != 0, F.concat(F.lit('"duration":"'), F.col("s_acctbal").cast("string"), F.lit('"'))).otherwise("")
    text = F.when(k % 7 == 0, "no json").otherwise(F.concat(F.lit('{"format":{'), length, F.lit('},"streams":['), streams, F.lit("]}")))
    p = load(spark, sf_dir, "supplier").withColumn("p", probe.source_info(text))
    broken = F.col("p").isNull() | (F.col("s_suppkey") % 7 == 0)
    return p.select(
        "s_suppkey",
        *[F.when(~broken, F.col(f"p.{c}")).alias(c) for c in ("duration", "has_video", "has_audio", "width", "frame_rate", "sample_rate")],
        broken.alias("broken")
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'CH-STEREO' WHEN p_size % 3 = 1 THEN 'CH-MONO' END AS channels, CASE
  WHEN p_size % 2 = 0 THEN 'PROJ-HEQU' END AS projection,
  p_size % 9 >= 6 AS fits FROM part""")
def video_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.74, 2.3.53: video layouts read, the last known token of a kind counts; which sources reach 5.1."""
    z = F.col("p_size")
    text = F.concat_ws(
        ",", F.when(z % 3 == 0, "CH-MONO, CH-STEREO").when(z % 3 == 1, "CH-MONO").otherwise("CH-NEW"),
        F.when(z % 2 == 0, "PROJ-RECT,PROJ-HEQU")
    )
    p = load(spark, sf_dir, "part").withColumn("x", rules.video_layout(text))
    return p.select("p_partkey", "x.channels", "x.projection", rules.layout_fits(z % 9, F.lit(6)).alias("fits"))


SYSTEMS = "SELECT * FROM (VALUES ('widevine', 'edef8ba9-79d6-4ace-a3c8-27dcd51d21ed'), ('playready', '9a04f079-9840-4286-ab92-e65be0885f95'), ('fairplay', '94ce86fb-07ff-4f43-adb8-93d2fa968ca2')) AS y(system, id)"


@query(f"""WITH y AS ({SYSTEMS}), c AS (SELECT c_custkey, c_name, c_custkey % 3 AS m FROM customer)
SELECT c_custkey, system, CASE WHEN system = 'fairplay' THEN 'SAMPLE-AES' ELSE 'SAMPLE-AES-CTR' END AS method, 'skd://' || c_custkey AS uri,
  CASE WHEN system = 'fairplay' THEN 'com.apple.streamingkeydelivery' ELSE 'urn:uuid:' || id END AS key_format, '1' AS key_format_versions,
  id AS system_id,
  printf('%08x', 32 + 18) || '7073736800000000' || replace(id, '-', '') || '00000012' || lower(hex(encode(c_name))) AS pssh
FROM c JOIN y ON system = CASE m WHEN 0 THEN 'widevine' WHEN 1 THEN 'playready' ELSE 'fairplay' END""")
def protection_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.4.15, 2.9.75–2.9.77: session keys, key formats, system ids and protection headers of each system."""
    m = F.col("c_custkey") % 3
    c = load(spark, sf_dir, "customer").withColumn("system", F.when(m == 0, "widevine").when(m == 1, "playready").otherwise("fairplay"))
    k = pipeline.session_keys(c, "system", F.concat(F.lit("skd://"), F.col("c_custkey").cast("string")))
    k = k.withColumn("system_id", ladders.system_id(F.col("system")))
    return k.select(
        "c_custkey", "system", "method", "uri", "key_format", "key_format_versions", "system_id",
        pssh_hex(F.col("system_id"), F.col("c_name").cast("binary")).alias("pssh")
    )


@query("SELECT count(*) AS n, count(*) AS n_distinct, 16 AS shortest, 16 AS longest FROM customer")
def random_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.63: a random key for each customer: as many keys as customers, 16 bytes each."""
    from ..stage import materialize

    k = materialize(load(spark, sf_dir, "customer").select(pipeline.random_key().alias("k")), "keys")
    return k.agg(
        F.count("k").alias("n"), F.countDistinct("k").alias("n_distinct"), F.min(F.octet_length("k")).alias("shortest"),
        F.max(F.octet_length("k")).alias("longest")
    )


@query("""SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN p_size % 4 = 1 THEN 'VIDEO-RANGE mismatch: expected PQ, got SDR' END, CASE
  WHEN p_size % 4 = 2 THEN 'VIDEO-RANGE missing: expected PQ' END,
  CASE WHEN p_size % 3 = 0 THEN 'SUPPLEMENTAL-CODECS missing for Dolby Vision content' END, CASE
  WHEN p_size % 3 = 1 THEN 'SUPPLEMENTAL-CODECS mismatch: expected dvh1.08.07/db4h, got other' END], lambda x: x IS NOT NULL), '|') AS hdr,
  array_to_string(list_filter([CASE WHEN p_size % 2 = 0
  AND p_size % 5 = 0 THEN 'Caption config provided but variant has no CLOSED-CAPTIONS attribute' END, CASE WHEN p_size % 2 = 1
  AND p_size % 5 <> 0 THEN 'Variant has CLOSED-CAPTIONS attribute but no caption config provided' END,
  CASE WHEN p_size % 2 = 0 AND p_size % 5 <> 0 AND p_size % 5 <> 1 THEN 'CLOSED-CAPTIONS attribute ''cc' || p_size % 5
  || ''' does not match config groupID ''cc1''' END], lambda x: x IS NOT NULL), '|') AS captions FROM part""")
def variant_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.34, 2.3.35: variants against an HDR and a caption configuration."""
    z = F.col("p_size")
    text = lambda cases, other=None: (F.when(*cases[0]).when(*cases[1]) if len(cases) > 1 else F.when(*cases[0])).otherwise(other)
    hdr = ladders.hdr_mismatch(
        text([(z % 4 == 1, "SDR"), (z % 4 == 2, F.lit(None))], "PQ"),
        text([(z % 3 == 0, F.lit(None)), (z % 3 == 1, "other")], "dvh1.08.07/db4h"), F.lit("PQ"), F.lit("dvh1.08.07/db4h")
    )
    captions = ladders.caption_mismatch(F.when(z % 5 != 0, F.concat(F.lit("cc"), (z % 5).cast("string"))), F.when(z % 2 == 0, "cc1"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(hdr, "|").alias("hdr"), F.array_join(captions, "|").alias("captions"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'missingRequiredAttribute N' WHEN c_custkey % 5 = 1 THEN 'invalidAttributeValue N 7x'
  WHEN c_custkey % 4 = 0 THEN 'missingRequiredAttribute D' WHEN c_custkey % 4 = 1 THEN 'invalidAttributeValue D 1.2.3'
  WHEN c_custkey % 3 = 0 THEN 'missingRequiredAttribute Q' WHEN c_custkey % 7 = 0 THEN 'missingRequiredAttribute E' END AS problem, CASE
  WHEN c_custkey % 5 > 1 THEN c_custkey END AS n, CASE WHEN c_custkey % 4 > 1 THEN c_acctbal END AS d,
  CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS q, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS e, '0x' || lower(hex(c_custkey)) AS h,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey || 'x' || c_custkey + 1 END AS size FROM customer""")
def required_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.7–2.1.10, 2.1.15, 2.1.17: required whole numbers, decimals, quoted and plain texts; hex; strict sizes."""
    k = F.col("c_custkey")
    n = F.when(k % 5 == 1, T.plain("N", F.lit("7x"))).when(k % 5 > 1, T.plain("N", k))
    d = F.when(k % 4 == 1, T.plain("D", F.lit("1.2.3"))).when(k % 4 > 1, T.plain("D", F.col("c_acctbal")))
    size = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit("x"), (k + 1).cast("string"))).otherwise(F.concat(k.cast("string"), F.lit("x")))
    text = T.attribute_list(
        n, d, F.when(k % 3 != 0, T.quoted("Q", F.col("c_name"))), F.when(k % 7 != 0, T.plain("E", F.col("c_mktsegment"))),
        T.plain("H", F.concat(F.lit("0x"), F.lower(F.hex(k)))), T.plain("RESOLUTION", size)
    )
    m = load(spark, sf_dir, "customer").select("c_custkey", A.attribute_map(text).alias("m"))
    f = F.col("m")
    p, r = A.problem(f, "T", N="int", D="double", Q="text", E="text"), A.resolution_of(f)
    return m.select(
        "c_custkey", F.when(
            p.isNotNull(), F.concat_ws(" ", p["code"], p["attribute"], p["value"])
        ).alias("problem"), A.int_of(f, "N").alias("n"), A.double_of(f, "D").alias("d"),
        A.text_of(f, "Q").alias("q"), A.text_of(f, "E").alias("e"), A.text_of(f, "H").alias("h"), F.concat(
            r["width"].cast("string"), F.lit("x"), r["height"].cast("string")
        ).alias("size"),
    )
