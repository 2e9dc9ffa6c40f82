"""Queries of ladders, settings, special playlists, encryption and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import media as M
from ..functions import text as T
from ..operators import audio, crypto, ladders, playlists
from ..operators.patterns import running_sum
from ..sources import manifest as S
from ..sources import tags, ttml
from .registry import DECIMAL_SQL, LISTS, digits, events, load, query

C = F.col
TIER_SQL = "CASE WHEN h < 600 THEN 1 WHEN h < 800 THEN 2 WHEN h < 1200 THEN 3 WHEN h < 1600 THEN 4 WHEN h < 2400 THEN 5 ELSE 6 END"
RANGE_SQL = f"""p AS (SELECT p_partkey, p_size * 50 AS h, CASE p_partkey % 4 WHEN 0 THEN 'h264' WHEN 1 THEN 'h265' WHEN 2 THEN 'av1'
  ELSE 'vp9' END AS c, p_partkey % 3 = 0 AS hdr FROM part),
b AS (SELECT *, CASE c WHEN 'h264' THEN [1000000, 2500000, 4000000, 8000000, 15000000, 40000000] WHEN 'av1' THEN [400000, 1000000, 1500000, 3000000,
  6000000, 15000000] ELSE [500000, 1500000, 2500000, 4000000, 8000000, 25000000] END[{TIER_SQL}] ::BIGINT * CASE WHEN hdr THEN 120
  ELSE 100 END // 100 AS lo,
  CASE c WHEN 'h264' THEN [2500000, 5000000, 8000000, 16000000, 30000000, 80000000] WHEN 'av1' THEN [1000000, 2000000, 4000000, 7000000, 16000000,
  40000000] ELSE [1500000, 3000000, 6000000, 10000000, 25000000, 60000000] END[{TIER_SQL}] ::BIGINT * CASE WHEN hdr THEN 120
  ELSE 100 END // 100 AS hi FROM p)"""


@query(f"""WITH {RANGE_SQL} SELECT p_partkey, lo::BIGINT AS low, hi::BIGINT AS high, ((lo + hi) // 2)::BIGINT AS bandwidth,
  CASE c WHEN 'h265' THEN 'hvc1.' || CASE WHEN hdr THEN '2.4' ELSE '1.6' END || '.L' || CASE WHEN h < 720 THEN 93 WHEN h < 1080 THEN 120
  WHEN h < 1440 THEN 123 WHEN h < 2160 THEN 150 WHEN h < 4320 THEN 153 ELSE 183 END || '.B0'
    WHEN 'h264' THEN CASE WHEN hdr THEN 'avc1.640033' ELSE 'avc1.640028' END WHEN 'av1' THEN CASE WHEN hdr THEN 'av01.0.09M.10'
  ELSE 'av01.0.09M.08' END ELSE CASE WHEN hdr THEN 'vp09.02.10.10' ELSE 'vp09.00.10.08' END END AS codecs FROM b""")
def bitrate_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.20–2.9.22, 2.9.25: ranges, bandwidth and codec string by height, codec and range."""
    k = C("p_partkey")
    codec = F.element_at(F.array(*map(F.lit, ("h264", "h265", "av1", "vp9"))), (k % 4 + 1).cast("int"))
    p = load(spark, sf_dir, "part").select("p_partkey", (C("p_size") * 50).alias("h"), codec.alias("c"), (k % 3 == 0).alias("hdr"))
    r = ladders.bitrate_range(C("h"), C("c"), C("hdr"))
    return p.select(
        "p_partkey", r["low"].alias("low"), r["high"].alias("high"),
        ladders.recommended_bandwidth(C("h"), C("c"), C("hdr")).alias("bandwidth"),
        ladders.codec_string(C("h"), C("c"), C("hdr")).alias("codecs")
    )


@query("""WITH n AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'h264' WHEN 1 THEN 'h265' WHEN 2 THEN 'av1' ELSE 'vp9' END AS codec
  FROM nation),
r(name, height, rung) AS (VALUES ('SD 480p', 480, 0), ('HD 720p', 720, 1), ('Full HD 1080p', 1080, 2), ('QHD 1440p', 1440, 3), ('4K UHD', 2160, 4),
  ('8K UHD', 4320, 5))
SELECT n_nationkey, codec, name, height, rung::INT AS rung, b::INT AS block, b = 1 AS is_fallback, CASE WHEN b = 0 THEN 'PQ'
  ELSE 'SDR' END AS video_range FROM n, r, (VALUES (0), (1)) AS s(b) WHERE height < 4320 OR codec IN ('h265', 'av1')""")
def adaptive_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.23, 2.4.11: HDR rungs and SDR fallbacks of each codec's ladder."""
    codec = F.element_at(F.array(*map(F.lit, ("h264", "h265", "av1", "vp9"))), (C("n_nationkey") % 4 + 1).cast("int"))
    out = ladders.adaptive_ladder(spark, load(spark, sf_dir, "nation").select("n_nationkey", codec.alias("codec")))
    return out.select("n_nationkey", "codec", "name", "height", "rung", "block", "is_fallback", "video_range")


D5 = "regexp_replace(printf('%.5f', {0}), '(\\.\\d+?)0+$', '\\1')"


@query(f"""WITH r AS (SELECT user_id, event_id // 500 AS seg, event_id, event_type, value / 100 AS d, row_number() OVER (PARTITION BY user_id,
  event_id // 500 ORDER BY event_id) - 1 AS part, max(event_id // 500) OVER (PARTITION BY user_id) AS top FROM events),
s AS (SELECT user_id, seg, any_value(top) AS top, sum(d) AS d, string_agg('#EXT-X-PART:DURATION=' || {D5.format('d')} || ',URI="seg' || seg || '.'
  || part || '.mp4"' || CASE WHEN event_type = 'view' THEN ',INDEPENDENT=YES' ELSE '' END || CASE WHEN event_type = 'error' THEN ',GAP=YES'
  ELSE '' END || chr(10), '' ORDER BY part) AS p FROM r GROUP BY 1, 2)
SELECT user_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:9' || chr(10) || '#EXT-X-TARGETDURATION:4' || chr(10)
  || '#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES,HOLD-BACK=12.0,PART-HOLD-BACK=1.50003' || chr(10) || '#EXT-X-PART-INF:PART-TARGET=0.50001'
  || chr(10) || '#EXT-X-MEDIA-SEQUENCE:' || min(seg) || chr(10)
  || string_agg(p || CASE WHEN seg < top THEN '#EXTINF:' || {D5.format('round(d, 6)')} || ',' || chr(10) || 'seg' || seg || '.m4s' || chr(10)
  ELSE '' END, '' ORDER BY seg) AS text FROM s GROUP BY 1""")
def low_latency_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.20, 2.2.21, 2.2.32, 2.2.33, 2.2.36, 2.4.8, 2.9.29, 2.9.30, 2.10.8: parts before their segment."""
    w = Window.partitionBy("user_id", "segment").orderBy("event_id")
    e = load(spark, sf_dir, "events").withColumn("segment", F.floor(C("event_id") / 500).cast("long")).withColumn("part", F.row_number().over(w) - 1)
    name = F.concat(F.lit("seg"), C("segment").cast("string"))
    p = e.select(
        "user_id", "segment", "part", (C("value") / 100).alias("duration"),
        F.concat(name, F.lit("."), C("part").cast("string"), F.lit(".mp4")).alias("uri"), (C("event_type") == "view").alias("independent"),
        (C("event_type") == "error").alias("gap")
    )
    s = p.groupBy("user_id", "segment").agg(F.round(F.sum("duration"), 6).alias("duration")).withColumn(
        "uri", F.concat(F.lit("seg"), C("segment").cast("string"), F.lit(".m4s"))
    )
    s = s.withColumn("open", C("segment") == F.max("segment").over(Window.partitionBy("user_id")))
    return tags.low_latency_playlist(s, p, ["user_id"], 4.0, 0.50001, C("open"))


KEYFRAMES = "SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, coalesce(sum((value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o, (value * 100)::BIGINT AS n FROM events"


@query(f"""SELECT user_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || ceil(max(value))::BIGINT || chr(10)
  || '#EXT-X-I-FRAMES-ONLY' || chr(10) || '#EXT-X-MAP:URI="init.mp4"' || chr(10)
  || string_agg(CASE WHEN event_type = 'error' THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END || '#EXTINF:' || printf('%.3f', value) || ','
  || chr(10) || '#EXT-X-BYTERANGE:' || n || '@' || o || chr(10) || 'all.mp4' || chr(10), '' ORDER BY event_id) || '#EXT-X-ENDLIST' || chr(10) AS text
  FROM ({KEYFRAMES}) GROUP BY 1""")
def iframe_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.44, 2.2.45."""
    e = load(spark, sf_dir, "events").select(
        "user_id", "event_id", C("value").alias("duration"), (C("event_type") == "error").alias("discontinuity"),
        F.round(C("value") * 100).cast("long").alias("length"), F.lit("all.mp4").alias("uri")
    )
    return tags.iframe_playlist(running_sum(e, ["user_id"], "event_id", C("length"), "offset", 4096), ["user_id"], "event_id", 7, "init.mp4")


@query(f"""SELECT user_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || ceil(max(value))::BIGINT || chr(10)
  || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10)
  || string_agg(CASE WHEN event_type = 'error' THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END || '#EXTINF:' || printf('%.3f', value) || ','
  || chr(10) || 'part-' || i || '.m4s' || chr(10), '' ORDER BY event_id) || '#EXT-X-ENDLIST' || chr(10) AS text FROM ({KEYFRAMES}) GROUP BY 1""")
def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.37, 2.2.38, 2.10.20: a finished recording, renumbered."""
    e = load(spark, sf_dir, "events").select(
        "user_id", "event_id", C("value").alias("duration"), (C("event_type") == "error").alias("discontinuity"), F.lit("x").alias("uri")
    )
    return tags.recording(e, ["user_id"], "event_id", True, "part-{index}.m4s")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n
  FROM events)
SELECT user_id, '#EXTM3U' || chr(10) || '#EXT-X-TARGETDURATION:' || ceil(max(value))::BIGINT || chr(10) || '#EXT-X-VERSION:3' || chr(10)
  || '#EXT-X-MEDIA-SEQUENCE:' || greatest(any_value(n) - 6, 0) || chr(10)
  || string_agg('#EXTINF:' || {DECIMAL_SQL.format('value')} || ',' || chr(10) || 'sub' || event_id || '.vtt' || chr(10), ''
  ORDER BY event_id) AS text FROM r WHERE k <= 6 GROUP BY 1""")
def subtitle_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.43."""
    e = load(spark, sf_dir, "events").select(
        "user_id", "event_id", C("value").alias("duration"),
        F.concat(F.lit("sub"), C("event_id").cast("string"), F.lit(".vtt")).alias("uri")
    )
    return tags.subtitle_playlist(e, ["user_id"], "event_id", 6)


@query("""WITH k AS (SELECT user_id, event_id // 1 AS event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
  round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS s FROM events),
t AS (SELECT *, floor(s * 1000)::BIGINT AS a, floor((s + value) * 1000)::BIGINT AS b FROM k)
SELECT user_id, 'WEBVTT' || chr(10) || chr(10) || string_agg((i + 1) || chr(10) || printf('%02d:%02d:%02d.%03d', a // 3600000, a // 60000 % 60,
  a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d.%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10)
  || 'https://t/sheet' || i // 12 || '.jpg#xywh=' || (i % 4) * 160 || ',' || (i // 4 % 3) * 90 || ',160,90' || chr(10), chr(10) ORDER BY i) AS vtt
  FROM t GROUP BY 1""")
def thumbnail_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.46, 2.2.47, 2.6.53: cues of thumbnail tiles."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    t = playlists.tile_layout(e, ["user_id"], "event_id", "value", 4, 3).withColumn("start", F.round("start", 3))
    return tags.tile_vtt(t.join(e.select("event_id", C("value").alias("duration")), "event_id"), ["user_id"], "https://t/", 160, 90)


@query(f"""SELECT user_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || ceil(max(value))::BIGINT || chr(10)
  || '#EXT-X-PLAYLIST-TYPE:EVENT' || chr(10)
  || string_agg(CASE WHEN i % 10 = 0 THEN '#EXT-X-KEY:METHOD=AES-128,URI="https://k"' || chr(10) ELSE '' END || '#EXTINF:' || printf('%.3f', value)
  || ',' || chr(10) || 's' || event_id || chr(10), '' ORDER BY event_id) AS text FROM ({KEYFRAMES}) GROUP BY 1""")
def key_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.2.55, 2.6.45: KEY lines put into finished playlists, every tenth segment."""
    e = load(spark, sf_dir, "events").select(
        "user_id", "event_id", C("value").alias("duration"), F.lit(False).alias("discontinuity"),
        F.concat(F.lit("s"), C("event_id").cast("string")).alias("uri")
    )
    return tags.inject_keys(tags.recording(e, ["user_id"], "event_id", False), "user_id", "text", "https://k", 10)


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 5 = 0 THEN 'Server URI is empty' END, CASE
  WHEN p_size % 4 = 0 THEN 'No pathways configured' END, CASE WHEN p_size % 4 = 0 OR p_size % 3 = 0 THEN 'Default pathway ''' || CASE
  WHEN p_size % 3 = 0 THEN 'C' ELSE 'A' END || ''' not found in pathways list' END, CASE
  WHEN p_size % 7 = 0 THEN 'Polling interval must be positive' END], lambda x: x IS NOT NULL), ';') AS steering,
  '{"VERSION":1,"TTL":' || p_size || ',"PATHWAY-PRIORITY":[' || CASE WHEN p_size % 4 = 0 THEN '' ELSE '"A","B"' END || ']}' AS manifest,
  array_to_string(list_filter([CASE WHEN p_size > 4 THEN 'Service ID ' || p_size || ' out of range 1-4 for cea608' END, CASE
  WHEN p_size = 1 THEN 'Duplicate service IDs found' END], lambda x: x IS NOT NULL), ';') AS captions,
  array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'Entry ' || p_size || ': DATA-ID is empty' END, CASE WHEN p_size % 3 = 0
  AND p_size % 5 = 0 THEN 'Entry ' || p_size || ': VALUE and URI are mutually exclusive' END, CASE WHEN p_size % 3 <> 0
  AND p_size % 5 <> 0 THEN 'Entry ' || p_size || ': either VALUE or URI must be provided' END], lambda x: x IS NOT NULL), ';') AS session_data,
  CASE WHEN p_size % 6 = 0 THEN 'segmentDuration must be greater than 0' WHEN p_size % 5 = 0 THEN 'audioSampleRate must be greater than 0'
  WHEN p_size % 2 = 0 AND p_size % 4 = 0 THEN 'videoHeight must be greater than 0 when video is enabled'
  WHEN p_size % 7 = 0 THEN 'recordingDirectory is required when recording is enabled'
  WHEN p_size % 11 = 0 THEN 'DVR requires slidingWindow playlist type, not event' WHEN 7 >= p_size % 6 THEN CASE
  WHEN p_size % 13 = 0 THEN 'lowLatency partTargetDuration must be less than segmentDuration' END END AS pipeline FROM part""")
def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.36, 2.3.37, 2.3.39, 2.3.40, 2.2.49: settings and what is wrong with them."""
    z, none = C("p_size"), F.lit(None).cast("string")
    ways = F.when(z % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"), F.lit("B")))
    pipeline = {
        "segmentDuration": z % 6, "audioBitrate": F.lit(1), "audioSampleRate": z % 5, "audioChannels": F.lit(2),
        "videoEnabled": z % 2 == 0, "videoBitrate": F.lit(1), "videoWidth": F.lit(1), "videoHeight": z % 4, "videoFrameRate": F.lit(30),
        "enableRecording": z % 7 == 0, "recordingDirectory": none, "enableDVR": z % 11 == 0, "playlistType": F.lit("event"),
        "partTargetDuration": F.when(z % 13 == 0, 7)
    }
    join = lambda a: F.array_join(a, ";")
    return load(spark, sf_dir, "part").select(
        "p_partkey", join(
            ladders.steering_problems(
                F.when(z % 5 == 0, "").otherwise("/s"), ways, F.when(z % 3 == 0, "C").otherwise("A"), F.when(z % 7 == 0, 0).otherwise(60)
            )
        ).alias("steering"), tags.steering_json(ways, z).alias("manifest"),
        join(ladders.caption_problems(F.lit("cea608"), F.array(F.lit(1), z))).alias("captions"),
        join(
            ladders.session_data_problems(z, F.when(z % 2 == 0, "").otherwise("id"), F.when(z % 3 == 0, "v"), F.when(z % 5 == 0, "u"))
        ).alias("session_data"),
        ladders.pipeline_problem(pipeline).alias("pipeline"))


@query("""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'starting' WHEN 'signup' THEN 'running'
  WHEN 'purchase' THEN 'stopping' ELSE 'failed' END AS st FROM events),
l AS (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
SELECT user_id, event_id, before, st AS state, (before = 'idle' AND st = 'starting') OR (before = 'starting' AND st IN ('running', 'failed'))
  OR (before = 'running' AND st IN ('stopping', 'failed')) OR (before = 'stopping' AND st IN ('stopped', 'failed')) AS legal FROM l
  WHERE before IS NOT NULL""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.41: which moves of a pipeline are legal."""
    names = F.create_map(*map(F.lit, ("view", "idle", "click", "starting", "signup", "running", "purchase", "stopping", "error", "failed")))
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.element_at(names, C("event_type")).alias("state"))
    e = e.withColumn("before", F.lag("state").over(Window.partitionBy("user_id").orderBy("event_id"))).where("before is not null")
    return e.select("user_id", "event_id", "before", "state", ladders.legal_transition(C("before"), C("state")).alias("legal"))


@query("""WITH u AS (SELECT substr(p_brand, 7)::BIGINT AS k, 'p' || p_size AS u FROM part UNION ALL SELECT substr(p_brand, 7)::BIGINT, 'b'
  || p_partkey FROM part WHERE p_size % 10 <> 0),
m AS (SELECT substr(p_brand, 7)::BIGINT AS k, list_sort(list('Variant ''p' || p_size || ''' has no backup URIs') FILTER (WHERE p_size % 10 = 0)) AS l
  FROM part GROUP BY 1),
d AS (SELECT k, count(u) <> count(DISTINCT u) AS dup FROM u GROUP BY 1)
SELECT k AS brand, array_to_string(list_concat(coalesce(l, []), CASE WHEN dup THEN ['Duplicate URIs found across variants and backups'] ELSE [] END),
  ';') AS problems FROM m JOIN d USING (k)""")
def redundancy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.38, 2.5.27, 2.8.1."""
    p = load(spark, sf_dir, "part").select(
        F.substr("p_brand", F.lit(7)).cast("long").alias("brand"), F.concat(F.lit("p"), C("p_size").cast("string")).alias("primary"),
        F.when(
            C("p_size") % 10 != 0, F.array(F.concat(F.lit("b"), C("p_partkey").cast("string")))
        ).otherwise(F.array().cast("array<string>")).alias("backup_uris")
    )
    return ladders.redundancy_problems(p, ["brand"]).select("brand", F.array_join("problems", ";").alias("problems"))


@query(
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN event_id END AS msn, CASE WHEN event_type = 'view' THEN event_id % 7 END AS part, CASE
  WHEN event_type = 'click' THEN 'YES' END AS skip FROM events"""
)
def reload_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.75: query strings of blocking reloads."""
    url = F.concat(
        F.lit("https://h/p.m3u8?_HLS_msn="), F.when(C("event_type") == "error", "x").otherwise(C("event_id").cast("string")),
        F.when(C("event_type") == "view", F.concat(F.lit("&_HLS_part="), (C("event_id") % 7).cast("string"))).otherwise(""),
        F.when(C("event_type") == "click", "&_HLS_skip=YES").otherwise("&_HLS_skip=maybe")
    )
    r = load(spark, sf_dir, "events").select("event_id", tags.reload_request(url).alias("r"))
    return r.select("event_id", C("r.msn").alias("msn"), C("r.part").alias("part"), C("r.skip").alias("skip"))


@query(
    """SELECT event_id, event_type AS class, make_timestamp(epoch_us(ts) // 1000 * 1000) AS start_date, round(value, 3) AS duration, CASE
  WHEN event_type IN ('view', 'click') THEN 'https://a/' || user_id END AS asset, CASE WHEN event_type IN ('view', 'click') THEN CASE event_type
  WHEN 'view' THEN 'uri' ELSE 'list' END END AS asset_kind FROM events"""
)
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.22, 2.1.23, 2.1.32, 2.1.73, 2.2.13, 2.9.81: date ranges written, scanned back, interstitials read."""
    e = load(spark, sf_dir, "events")
    asset = F.concat(F.lit("https://a/"), C("user_id").cast("string"))
    client = F.when(C("event_type") == "view", F.create_map(F.lit("X-ASSET-URI"), asset)).when(
        C("event_type") == "click", F.create_map(F.lit("X-ASSET-LIST"), asset)
    ).otherwise(F.create_map().cast("map<string,string>"))
    rows = e.select(
        "event_id", C("event_id").cast("string").alias("id"), C("ts").cast("timestamp").alias("start_date"),
        C("event_type").alias("class"), F.lit(None).cast("timestamp").alias("end_date"), C("value").alias("duration"),
        F.lit(None).cast("double").alias("planned_duration"), F.lit(False).alias("end_on_next"), client.alias("client")
    )
    back = S.date_ranges(S.lines(rows.select("event_id", tags.date_range_line().alias("text")), "event_id"), "event_id")
    ads = tags.interstitials(back).select("event_id", "asset", "asset_kind")
    return back.select("event_id", "class", C("start_date").cast("timestamp_ntz").alias("start_date"), "duration").join(ads, "event_id", "left")


@query("""SELECT event_id, 32 * ((length(event_type || props) + 16) // 16) AS hex_digits, true AS same FROM events""")
def segment_encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.64–2.9.66: AES-128-CBC with the IV of the sequence number, there and back."""
    key, iv = F.lit(bytearray(range(16))), crypto.iv_bytes(C("event_id"))
    e = load(spark, sf_dir, "events").select("event_id", F.concat("event_type", "props").cast("binary").alias("data"))
    out = crypto.decrypt(crypto.encrypt(e, "data", key, iv), "encrypted", key, iv)
    return out.select("event_id", F.length(F.hex("encrypted")).cast("long").alias("hex_digits"), (C("decrypted") == C("data")).alias("same"))


@query(
    """SELECT user_id, count(*) AS cues, round(sum(a), 3) AS begins, round(sum(b), 3) AS ends, string_agg(event_type || ' & <' || event_id || '>',
  '|' ORDER BY a, event_id) AS texts FROM (SELECT user_id, event_id, event_type, round(event_id * 0.5::DOUBLE, 3) AS a,
  round(event_id * 0.5::DOUBLE + value, 3) AS b FROM events) GROUP BY 1"""
)
def ttml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.68, 2.1.69, 2.2.48, 2.9.13, 2.9.14: cues written as TTML and scanned back."""
    e = load(spark, sf_dir, "events").select(
        C("user_id").alias("doc_id"), F.round(C("event_id") * 0.5, 3).alias("begin"),
        F.round(C("event_id") * 0.5 + C("value"), 3).alias("end"),
        F.concat("event_type", F.lit(" & <"), C("event_id").cast("string"), F.lit(">")).alias("text")
    )
    back = ttml.cues(ttml.render(e))
    g = back.groupBy("doc_id").agg(
        F.count("*").alias("cues"), F.round(F.sum("begin"), 3).alias("begins"), F.round(F.sum("end"), 3).alias("ends"),
        F.array_sort(F.collect_list(F.struct("begin", "pos", "text"))).alias("_t")
    )
    return g.select(C("doc_id").alias("user_id"), "cues", "begins", "ends", F.array_join(F.transform("_t", lambda x: x["text"]), "|").alias("texts"))


@query("""SELECT s_suppkey AS doc_id, s_suppkey + 1 AS sequence, s_suppkey * 1000 AS time, 2000::BIGINT AS duration,
  (s_suppkey + 0.25)::DOUBLE AS begin, (s_suppkey + 1.5)::DOUBLE AS "end", s_name || ' & ' || s_nationkey AS text, CASE
  WHEN s_suppkey % 2 = 0 THEN 'r1' END AS region, 's' || s_nationkey AS style,
  's' || s_nationkey AS style_id, CASE WHEN s_suppkey % 3 = 0 THEN '#ff0000' END AS color, 'r1' AS region_id, (s_nationkey + 0.5)::DOUBLE AS x,
  80.0::DOUBLE AS width FROM supplier""")
def subtitle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.1.68, 2.2.48, 2.2.72: cues with styles and regions as documents, each the sample of a media segment, read back."""
    from ..sources.binary import fragment_table

    k = C("s_suppkey")
    nation = C("s_nationkey").cast("string")
    s = load(spark, sf_dir, "supplier").withColumn("doc_id", k)
    cue = s.select(
        "doc_id", (k + 0.25).alias("begin"), (k + 1.5).alias("end"), F.concat("s_name", F.lit(" & "), nation).alias("text"),
        F.when(k % 2 == 0, "r1").alias("region"), F.concat(F.lit("s"), nation).alias("style")
    )
    none = F.lit(None).cast("string")
    style = s.select(
        "doc_id", F.lit(0).alias("pos"), F.concat(F.lit("s"), nation).alias("id"),
        *[(F.when(k % 3 == 0, "#ff0000") if c == "color" else none).alias(c) for c in ttml.STYLE]
    )
    region = s.select(
        "doc_id", F.lit(0).alias("pos"), F.lit("r1").alias("id"), (C("s_nationkey") + 0.5).alias("x"), F.lit(0.0).alias("y"),
        F.lit(80.0).alias("width"), F.lit(10.0).alias("height")
    )
    docs = ttml.render(cue, "doc_id", "en", style, region).select(
        "doc_id", "text", (C("doc_id") + 1).alias("sequence"), (C("doc_id") * 1000).alias("at"), F.lit(2000).cast("long").alias("length")
    )
    files = ttml.segments(docs, "sequence", "at", "length").select("doc_id", "content")
    read = fragment_table(files, "doc_id").select("doc_id", "sequence", "time", "duration", C("payload").cast("string").alias("text"))
    back = ttml.cues(read).select("doc_id", "begin", "end", "text", "region", "style")
    looks = ttml.styles(read).select("doc_id", C("id").alias("style_id"), "color").join(
        ttml.regions(read).select("doc_id", C("id").alias("region_id"), "x", "width"), "doc_id"
    )
    return read.drop("text").join(back, "doc_id").join(looks, "doc_id")


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT vec_id, list_transform(range(1, len(e) + 1), lambda i: list_aggregate(e[greatest(1, i - 1):least(len(e), i + 1)],
  'sum') / len(e[greatest(1, i - 1):least(len(e), i + 1)])) AS e FROM v)
SELECT vec_id, {LISTS.format('list_transform(range(0, ceil(len(e) * 16000.0 / 48000)::BIGINT), lambda i: e[i * 3 + 1])')} AS samples FROM f""")
def resample_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.55, 2.9.59: box filter, then a third of the rate."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", M.resample_medium(C("embedding"), 48000, 16000).alias("a"))
    return v.select("vec_id", digits("a").alias("samples"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), o AS (SELECT vec_id, e, unnest(range(0, len(e) // 2)) AS i
  FROM v),
x AS (SELECT vec_id, i, e[j + 1] AS y, (i * 2.0 - j) / 2.0 AS x FROM (SELECT vec_id, e, i, unnest(range(greatest(0, i * 2 - 8), least(len(e) - 1,
  i * 2 + 8) + 1)) AS j FROM o)),
w AS (SELECT vec_id, i, y, CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x) / (pi() * x) END * CASE WHEN x = 0 THEN 1
  ELSE sin(pi() * x / 4) / (pi() * x / 4) END AS w FROM x)
SELECT vec_id, i::INT AS i, round(sum(w * y) / sum(w), 6) AS sample FROM w GROUP BY 1, 2""")
def resample_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.56: half the rate by a windowed sinc."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(M.resample_lanczos(C("embedding"), 48000, 24000)).alias("i", "sample"))
    return v.select("vec_id", "i", F.round("sample", 6).alias("sample"))


#: The two weighting sections in SQL, of the sample x and the samples before.
SECTION = "{b[0]} * {x} + {b[1]} * {x}1 + {b[2]} * {x}2 - ({a[0]}) * {y}1 - ({a[1]}) * {y}2"
FIRST, SECOND = (SECTION.format(b=b, a=a, x=x, y=y) for (b, a), x, y in zip(audio.K_WEIGHTING[48000], "xy", "yz", strict=True))
LEVEL = "(-0.691::DOUBLE + 10 * log10({0}))"


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, len(embedding) * 12 AS n FROM embeddings),
f AS (SELECT vec_id, ch, e, n, -1 AS i, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2, 0.0::DOUBLE AS z1,
  0.0::DOUBLE AS z2 FROM v, (VALUES (0), (1)) t(ch)
  UNION ALL SELECT vec_id, ch, e, n, i + 1, x, x1, y, y1, {SECOND}, z1 FROM (SELECT *, {FIRST} AS y FROM (SELECT *,
  e[(2 * (i + 1) + ch) % len(e) + 1] AS x FROM f WHERE i < n - 1))),
g AS (SELECT vec_id, i, any_value(n) AS n, avg(z1 * z1) AS en FROM f WHERE i >= 0 GROUP BY 1, 2),
w AS (SELECT *, avg(en) OVER (PARTITION BY vec_id ORDER BY i ROWS 39 PRECEDING) AS m, avg(en) OVER (PARTITION BY vec_id
  ORDER BY i ROWS 299 PRECEDING) AS s FROM g),
b AS (SELECT vec_id, m, {LEVEL.format('m')} AS l FROM w WHERE i >= 39 AND (i - 39) % 10 = 0 AND {LEVEL.format('m')} > -70),
gate AS (SELECT vec_id, {LEVEL.format('avg(m)')} - 10 AS l FROM b GROUP BY 1),
it AS (SELECT b.vec_id, {LEVEL.format('avg(m)')} AS integrated FROM b JOIN gate USING (vec_id) WHERE b.l > gate.l GROUP BY 1),
h AS (SELECT vec_id, {LEVEL.format('s')} AS l FROM w WHERE i >= 299 AND (i - 299) % 100 = 0 AND {LEVEL.format('s')} > -70),
k AS (SELECT h.vec_id, list_sort(list(h.l)) AS l FROM h JOIN (SELECT vec_id, avg(l) - 20 AS least FROM h GROUP BY 1) m USING (vec_id)
  WHERE h.l > least GROUP BY 1),
t AS (SELECT vec_id, max(m) FILTER (WHERE i = n - 1) AS m, max(s) FILTER (WHERE i = n - 1) AS s FROM w GROUP BY 1)
SELECT vec_id, round(integrated, 6) AS integrated, round(CASE
  WHEN len(l) > 1 THEN l[floor(len(l) * 0.95::DOUBLE)::BIGINT + 1] - l[floor(len(l) * 0.10::DOUBLE)::BIGINT + 1] ELSE 0 END, 6) AS "range",
  round({LEVEL.format('m')}, 6) AS momentary, round({LEVEL.format('s')}, 6) AS short_term
FROM t LEFT JOIN it USING (vec_id) LEFT JOIN k USING (vec_id)""")
def loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5.20, 2.5.21, 2.6.34–2.6.37, 2.9.38: gated loudness of stereo signals; the SQL filters sample by sample."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", F.flatten(F.array_repeat(C("embedding"), 24)).alias("samples"))
    out = audio.loudness(v, "vec_id", "samples", 2, 100)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("integrated", "range", "momentary", "short_term")])


@query(
    """WITH n AS (SELECT *, epoch_us(ts) AS us FROM events) SELECT user_id, event_id FROM n WHERE us BETWEEN 1704672000000000 AND 1705276800000000
  AND NOT EXISTS (SELECT 1 FROM n d WHERE d.user_id = n.user_id AND d.event_type = 'purchase' AND d.value > 100)"""
)
def upcoming_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.42, 2.3.46, 2.8.2: ranges inside two dates of users without a completed one."""
    from ..operators import intervals

    e = events(spark, sf_dir)
    inside = intervals.in_range(e, "us", F.lit(1704672000000000), F.lit(1705276800000000))
    return intervals.upcoming(inside, e.where("event_type = 'purchase' and value > 100"), "user_id", "us", F.lit(0)).select("user_id", "event_id")
