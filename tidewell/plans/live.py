"""Queries over live pipelines: counters, recordings, windows, lookups, playlists, facades, and streams run dry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import engine
from ..functions import media as M
from ..operators import crypto, intervals, pipeline, playlists, segmenter, transport
from ..sources import binary as B
from ..sources import tags
from ..sources import transport_stream as TS
from ..sources import writers as W
from ..streaming import stateful
from .registry import LIVE_SQL, load, query

SEGMENTS = "s AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")


@query(f"""WITH {SEGMENTS}, t AS (SELECT *, sum(value) OVER w AS seconds, sum(event_id) OVER w AS bytes FROM s WINDOW w AS (PARTITION BY user_id
  ORDER BY event_id))
SELECT user_id, event_id, i + 1 AS segments_so_far, round(seconds, 6) AS seconds_so_far, bytes::BIGINT AS bytes_so_far FROM t""")
def pipeline_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10.22: the counters of each pipeline after each of its segments."""
    t = pipeline.ticks(events(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", "event_id", 1024)
    return t.select("user_id", "event_id", "segments_so_far", F.round("seconds_so_far", 6).alias("seconds_so_far"), "bytes_so_far")


@query(f"""WITH {SEGMENTS}, t AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM s)
SELECT user_id, count(*) AS segments, max(event_id) AS last_event, round(sum(value), 6) AS seconds FROM t WHERE total <= 900 GROUP BY 1""")
def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10.19: what fits a recording of 900 seconds."""
    r = pipeline.record(events(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 900.0, 1024)
    return r.groupBy("user_id").agg(
        F.count("*").alias("segments"), F.max("event_id").alias("last_event"), F.round(F.sum("value"), 6).alias("seconds")
    )


@query(
    """SELECT e.user_id, e.event_id, (SELECT min(s.event_id) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'view'
  AND s.event_id >= e.event_id) AS segment FROM events e WHERE e.event_type = 'click'"""
)
def queued_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.8.5, 2.10.18: metadata goes out with the next segment, and waits where none follows."""
    e = events(spark, sf_dir)
    items = e.where("event_type = 'click'").select("user_id", "event_id")
    segments = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("index"), F.col("event_id").alias("begin"))
    return pipeline.attach_metadata(items, segments, ["user_id"], "event_id", "index", "begin")


@query("""WITH e AS (SELECT *, value / 60 AS q FROM events), g AS (SELECT *, CASE WHEN q > 0.9 THEN 4 WHEN q > 0.7 THEN 3 WHEN q > 0.5 THEN 2
  WHEN q > 0.3 THEN 1 ELSE 0 END AS o FROM e)
SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'degraded' END AS event FROM g WHERE event_type = 'error' OR o < 2""")
def quality_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.42, 2.10.24: quality events that are told: lost connections and grades under fair."""
    state = F.when(F.col("event_type") == "error", "failed").otherwise("connected")
    return pipeline.route_quality(events(spark, sf_dir), M.grade(F.col("value") / 60), state).select("user_id", "event_id", "event")


@query(
    """SELECT user_id, (max(epoch_us(ts)) - min(epoch_us(ts)))::BIGINT AS micros, count(*) AS segments, sum(event_id)::BIGINT AS bytes,
  arg_max(event_type, event_id) AS reason, round(sum(value), 6) AS transcode_seconds, round(CASE WHEN sum(value) > 0 THEN 3600 / sum(value)
  ELSE 0 END, 9) AS speed FROM events GROUP BY 1"""
)
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5.2, 2.5.16, 2.5.17: what each run came to, its total transcoding time and speed."""
    e = events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    r = pipeline.run_summary(
        e.withColumn("at", F.struct("us", "event_id")).withColumn("at_us", F.col("us")), ["user_id"], "us", "event_id", "event_type"
    ).drop("reason")
    last = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("reason"), F.sum("value").alias("spent"))
    return r.join(last, "user_id").select(
        "user_id", F.col("seconds").alias("micros"), "segments", "bytes", "reason", F.round("spent", 6).alias("transcode_seconds"),
        F.round(pipeline.speed_factor(F.lit(3600.0), F.col("spent")), 9).alias("speed")
    )


@query(f"""WITH {SEGMENTS}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), k AS (SELECT s.* FROM s JOIN n USING (user_id) WHERE i >= n - 8)
SELECT user_id, min(event_id) AS oldest, max(event_id) AS newest, arg_min(event_type, i) FILTER (WHERE i % 4 = 2) AS kind_at_index,
  count(*) FILTER (WHERE event_type IN ('view', 'click')) AS in_range, max(CASE WHEN i = 0 THEN event_id END) AS evicted FROM k GROUP BY 1""")
def buffer_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.44, 2.3.45, 2.3.47, 2.7.5, 2.6.27: a buffer of the last eight segments: oldest, newest, by index, by range, null once evicted."""
    from ..operators.patterns import running_sum

    s = running_sum(events(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.lit(1).cast("long"), "i", 1024)
    k = playlists.last_segments(s, ["user_id"], "i", 8)
    at = F.when(F.col("i") % 4 == 2, F.col("i"))
    return k.groupBy("user_id").agg(
        F.min("event_id").alias("oldest"), F.max("event_id").alias("newest"), F.min_by("event_type", at).alias("kind_at_index"),
        F.count_if(F.col("event_type").isin("view", "click")).alias("in_range"), F.max(F.when(F.col("i") == 0, F.col("event_id"))).alias("evicted"),
    )


EVENT_LINE = "CASE WHEN event_type = 'error' THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END || '#EXTINF:' || printf('%.3f', value) || ',' || chr(10) || 's' || event_id || '.{ext}' || chr(10)"


@query(f"""SELECT user_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || ceil(max(value))::BIGINT || chr(10)
  || '#EXT-X-PLAYLIST-TYPE:EVENT' || chr(10) || string_agg({EVENT_LINE.replace('{ext}', 'ts')}, '' ORDER BY event_id) AS growing,
 '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || ceil(max(value))::BIGINT || chr(10)
  || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) || '#EXT-X-MAP:URI="init.mp4"' || chr(10) || string_agg({EVENT_LINE.replace('{ext}', 'ts')}, ''
  ORDER BY event_id) || '#EXT-X-ENDLIST' || chr(10) AS done FROM events GROUP BY 1""")
def event_and_vod_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.26, 2.2.51, 2.2.52: all segments of a stream as an event playlist that grows, and as a finished one."""
    s = events(spark, sf_dir).select(
        "user_id", "event_id", F.col("value").alias("duration"), (F.col("event_type") == "error").alias("discontinuity"),
        F.concat(F.lit("s"), F.col("event_id").cast("string"), F.lit(".ts")).alias("uri")
    )
    growing = tags.recording(s, ["user_id"], "event_id", False).withColumnRenamed("text", "growing")
    return growing.join(tags.recording(s, ["user_id"], "event_id", True, init="init.mp4").withColumnRenamed("text", "done"), "user_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_id, value, i, 0 AS seg, value AS acc FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.value, e.i, CASE WHEN f.acc + e.value >= 50 THEN f.seg + 1 ELSE f.seg END, CASE
  WHEN f.acc + e.value >= 50 THEN e.value ELSE f.acc + e.value END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, seg AS segment_index, count(*) AS frames, round(sum(value), 6) AS duration, true AS independent FROM f GROUP BY 1, 2""")
def audio_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.5: audio may be cut at any frame; a full segment opens the next."""
    e = events(spark, sf_dir).select("user_id", "event_id", "value")
    a = segmenter.assign_segments(e, ["user_id"], ["event_id"], "value", None, 50.0, 1e9)
    return segmenter.build_segments(a, ["user_id"], "event_id", "value").select(
        "user_id", "segment_index", "frames", F.round("duration", 6).alias("duration"), "independent"
    )


@query(LIVE_SQL + """SELECT s.user_id, s.segment_index, s.frames, count(a.event_id) AS audio_frames FROM s LEFT JOIN (SELECT user_id, event_id
  FROM events WHERE event_type = 'click') a
ON a.user_id = s.user_id AND a.event_id BETWEEN s.first_frame AND s.last_frame GROUP BY 1, 2, 3""")
def video_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.6: video cut at keyframes, its boundaries forced on the audio."""
    e = events(spark, sf_dir).select("user_id", "event_id", "value", "event_type")
    cut = segmenter.assign_segments(e, ["user_id"], ["event_id"], "value", F.col("event_type") == "view", 60.0, 90.0)
    s = segmenter.build_segments(cut, ["user_id"], "event_id", "value", F.col("event_type") == "view")
    audio = cut.where("event_type = 'click'").groupBy("user_id", "segment_index").agg(F.count("*").alias("audio_frames"))
    return s.join(audio, ["user_id", "segment_index"], "left").select(
        "user_id", "segment_index", "frames", F.coalesce("audio_frames", F.lit(0).cast("long")).alias("audio_frames")
    )


@query("""WITH e AS (SELECT user_id, event_id, trunc(value * 1000)::BIGINT AS v, CASE WHEN event_id % 7 = 0 THEN 48000 ELSE 90000 END AS ts
  FROM events), f AS (SELECT user_id, arg_min(ts, event_id) AS ts FROM e GROUP BY 1)
SELECT user_id, sum(CASE WHEN e.ts = f.ts THEN v ELSE 0 END)::BIGINT / any_value(f.ts)::DOUBLE AS duration FROM e JOIN f USING (user_id)
  GROUP BY 1""")
def exact_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.3: durations from whole ticks of the first frame's clock."""
    e = events(spark, sf_dir).select(
        "user_id", "event_id", M.ticks(F.col("value"), F.lit(1000)).alias("v"),
        F.when(F.col("event_id") % 7 == 0, 48000).otherwise(90000).alias("timescale")
    )
    return segmenter.exact_duration(e, ["user_id"], "v", "timescale", "event_id")


@query("""WITH r AS (SELECT user_id, event_id, event_id // 200 AS seg, max(event_id // 200) OVER (PARTITION BY user_id) AS top FROM events)
SELECT user_id, count(*) FILTER (WHERE seg > top - 3) AS partials, (max(event_id) + 5 - min(event_id))::DOUBLE AS covered FROM r GROUP BY 1""")
def retained_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5.25, 2.5.26: parts that are kept, and the time from the first start to the last end."""
    e = events(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("event_id") / 200).cast("long").alias("segment"))
    p = playlists.parts(e, ["user_id"], "segment", "event_id", 3, 3)
    covered = (F.max(F.col("event_id") + 5.0) - F.min("event_id")).cast("double")
    return p.groupBy("user_id").agg(F.count_if("retained").alias("partials"), covered.alias("covered"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type FROM events WHERE event_id % 20 = 0), r AS (SELECT *,
  ts + INTERVAL 90000 SECOND AS until FROM e)
SELECT user_id, event_id, '#EXT-X-DATERANGE:ID="r' || event_id || '",START-DATE="' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || printf('%03d',
  (epoch_us(ts) // 1000) % 1000) || 'Z",CLASS="' || event_type || '",DURATION=90000.0' AS line
FROM r WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' AND until > TIMESTAMP '2024-01-10 00:00:00'""")
def active_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.48: the ranges that are open at a moment, as they are rendered."""
    e = events(spark, sf_dir).where(F.col("event_id") % 20 == 0)
    none = F.lit(None)
    r = e.select(
        "user_id", "event_id", F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"),
        F.col("ts").cast("timestamp").alias("start_date"), F.col("event_type").alias("class"), none.cast("timestamp").alias("end_date"),
        F.lit(90000.0).alias("duration"), none.cast("double").alias("planned_duration"), F.lit(False).alias("end_on_next"),
        none.cast("map<string,string>").alias("client")
    )
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    active = intervals.in_range(
        r, "start_date", now - F.expr("interval 90000 seconds"), now
    ).where(F.col("start_date") + F.expr("interval 90000 seconds") > now)
    return active.select("user_id", "event_id", tags.date_range_line().alias("line"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i
  FROM events),
f AS (SELECT user_id, event_id, value, i, CASE WHEN event_type = 'view' THEN 0 ELSE -1 END AS seg, CASE WHEN event_type = 'view' THEN value
  ELSE 0 END AS held FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.value, e.i, CASE WHEN e.event_type = 'view' AND (f.seg < 0 OR f.held >= 60) THEN f.seg + 1
  ELSE f.seg END, CASE WHEN e.event_type = 'view' AND (f.seg < 0 OR f.held >= 60) THEN e.value ELSE f.held + e.value END FROM f
  JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1),
s AS (SELECT user_id, seg, count(*) AS samples, sum(value) AS d FROM f WHERE seg >= 0 GROUP BY 1, 2)
SELECT user_id, count(*) AS segments, sum(samples)::BIGINT AS samples, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10)
  || '#EXT-X-TARGETDURATION:' || ceil(max(d))::BIGINT || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) || '#EXT-X-MAP:URI="init.mp4"' || chr(10)
  || string_agg('#EXTINF:' || printf('%.3f', d) || ',' || chr(10) || 'segment_' || seg || '.m4s' || chr(10), '' ORDER BY seg) || '#EXT-X-ENDLIST'
  || chr(10) AS text FROM s GROUP BY 1""")
def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11.1, 2.12.15: the segment facade, its rows passed through a hook, and the playlist rendered from them."""
    e = events(spark, sf_dir).select("user_id", "event_id", "value", "event_type")
    rows, text = engine.segment(e, ["user_id"], "event_id", "value", F.col("event_type") == "view", 60.0)
    seen = engine.transform(rows, lambda s: s.groupBy("user_id").agg(F.count("*").alias("segments"), F.sum("samples").alias("samples")))
    return seen.join(text, "user_id")


VOD_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i
  FROM events),
f AS (SELECT user_id, event_id, event_type, value, i, CASE WHEN event_type = 'view' THEN 0 ELSE -1 END AS seg, CASE
  WHEN event_type = 'view' THEN value ELSE 0 END AS held FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.event_type, e.value, e.i, CASE WHEN e.event_type = 'view' AND (f.seg < 0 OR f.held >= 60) THEN f.seg + 1
  ELSE f.seg END, CASE WHEN e.event_type = 'view' AND (f.seg < 0 OR f.held >= 60) THEN e.value ELSE f.held + e.value END FROM f
  JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1),
t AS (SELECT *, round(value * 1000)::BIGINT AS ticks FROM f WHERE seg >= 0),
u AS (SELECT *, sum(ticks) OVER (PARTITION BY user_id ORDER BY event_id) - ticks AS begun FROM t)
"""


def vod_samples(spark: SparkSession, sf_dir: str, container: str) -> DataFrame:
    """(user_id, segment_index, content) of events as samples, cut at views."""
    e = events(spark, sf_dir).select(
        "user_id", "event_id", "value", (F.col("event_type") == "view").alias("sync"),
        F.concat("event_type", F.lit("/"), F.col("event_id").cast("string")).cast("binary").alias("payload")
    )
    return engine.segment_files(
        e, ["user_id"], "event_id", "value", "payload", "sync", 60.0, container, 1000
    ).withColumn("path", F.struct("user_id", "segment_index"))


@query(
    VOD_SQL + """SELECT user_id, seg AS segment_index, (seg + 1)::BIGINT AS sequence, begun::BIGINT AS time, ticks AS duration,
  event_type = 'view' AS sync, event_type || '/' || event_id AS payload FROM u"""
)
def vod_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12.11, 2.12.6: finished streams cut and written as fragmented MP4, every sample read back with its time."""
    files = vod_samples(spark, sf_dir, "fmp4")
    return B.fragment_table(files, "path").select(
        "path.user_id", "path.segment_index", "sequence", "time", "duration", "sync", F.col("payload").cast("string").alias("payload")
    )


@query(VOD_SQL + """SELECT user_id, seg AS segment_index, (begun * 90)::BIGINT AS pts, event_type || '/' || event_id AS payload FROM u""")
def vod_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12.12, 2.6.18: finished streams cut and written as transport streams, every unit read back with its time."""
    files = vod_samples(spark, sf_dir, "ts")
    return TS.unit_table(files, "path").select("path.user_id", "path.segment_index", "pts", F.col("payload").cast("string").alias("payload"))


@query("""SELECT s_suppkey, true AS opened, octet_length(encode(s_name)) // 16 * 16 + 16 AS size, 'identity' AS provider FROM supplier""")
def encrypted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12.8, 2.11.5, 2.11.7: payloads sealed by the facade with keys that a provider (any column) gives, and opened again."""
    key = F.substr(F.unhex(F.sha2(F.col("s_suppkey").cast("string").cast("binary"), 256)), F.lit(1), F.lit(16))
    s = load(spark, sf_dir, "supplier").withColumn("payload", F.col("s_name").cast("binary"))
    sealed = engine.encrypt(s, "payload", key, "s_suppkey")
    back = crypto.decrypt(sealed, "encrypted", key, crypto.iv_bytes(F.col("s_suppkey")))
    return back.select(
        "s_suppkey", (F.col("decrypted") == F.col("payload")).alias("opened"), F.octet_length("encrypted").alias("size"),
        F.lit("identity").alias("provider")
    )


@query(LIVE_SQL + "SELECT user_id, segment_index, frames, round(duration, 6) AS duration, first_frame, last_frame, independent FROM s")
def streamed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10.1, 2.6.1, 2.6.4: the streaming segmenter over three micro-batches, flushed at the end, gives what the batch one gives."""
    e = events(spark, sf_dir).select("event_id", "user_id", "value", "event_type")
    last = F.lit("end").alias("event_type")
    ends = e.groupBy("user_id").agg(F.lit(1 << 40).cast("long").alias("event_id")).select("event_id", "user_id", F.lit(0.0).alias("value"), last)
    make = lambda s: stateful.live_segments(
        s, ["user_id"], "event_id", "value", F.col("event_type") == "view", 60.0, 90.0, F.col("event_type") == "end"
    )
    out = stateful.drained(e.unionByName(ends), make, "segments", 3)
    return out.select("user_id", "segment_index", "frames", F.round("duration", 6).alias("duration"), "first_frame", "last_frame", "independent")


@query("""WITH e AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
  s AS (SELECT user_id, g, count(*) AS frames, min(event_id) AS first_frame, max(event_id) AS last_frame FROM e WHERE event_type <> 'error'
  GROUP BY 1, 2)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY g) - 1)::INT AS segment_index, frames, first_frame, last_frame
  FROM s QUALIFY g < max(g) OVER (PARTITION BY user_id) OR EXISTS (SELECT 1 FROM events x WHERE x.user_id = s.user_id AND x.event_type = 'error'
  AND x.event_id > s.last_frame)""")
def forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10.2: boundaries forced from outside close the open segment; without one they do nothing."""
    e = events(spark, sf_dir).select("event_id", "user_id", "value", "event_type")
    make = lambda s: stateful.live_segments(
        s, ["user_id"], "event_id", "value", F.lit(False), 1e12, 1e12, F.col("event_type") == "error"
    )
    return stateful.drained(e, make, "forced", 3).select("user_id", "segment_index", "frames", "first_frame", "last_frame")


@query(f"""WITH {SEGMENTS} SELECT user_id, event_id AS last_index, first_value(event_id) OVER w AS first_index, greatest(i - 4, 0) AS media_sequence,
  coalesce(count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING
  AND 5 PRECEDING), 0) AS discontinuity_sequence, ceil(max(value) OVER w)::BIGINT AS target_duration
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def streamed_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10.3, 2.10.4, 2.10.23: the live playlist's state after each segment, kept by the stream; discontinuities are counted once evicted."""
    e = events(spark, sf_dir).select("event_id", "user_id", "value", "event_type")
    return stateful.drained(
        e, lambda s: stateful.playlist_states(s, ["user_id"], "event_id", "value", F.col("event_type") == "error"), "playlists", 3
    )


@query("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_extendedprice) - 1 AS i, l_partkey FROM lineitem WHERE l_orderkey % 20 = 0)
SELECT k, count(*) AS frames, sum(l_partkey % 300 + 7)::BIGINT AS bytes, 48000 AS sample_rate FROM l GROUP BY 1""")
def streamed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10.26: frames of byte chunks that are cut anywhere: what a chunk leaves over waits for the next."""
    li = load(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 20 == 0)
    x = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    files = W.written(x, ["x"], lambda x: b"".join(B.adts_header(2, 48000, 2, r["l_partkey"] % 300) + b"\1" * (r["l_partkey"] % 300) for r in x))
    n = F.sequence(F.lit(0), F.floor((F.octet_length("content") - 1) / 100).cast("int"))
    chunks = files.select("k", "content", F.explode(n).alias("i")).select(
        "i", "k", F.substr("content", F.col("i") * 100 + 1, F.lit(100)).alias("content")
    )
    out = stateful.drained(chunks, lambda s: stateful.framed(s, ["k"], "i", "content"), "frames", 3)
    return out.groupBy("k").agg(F.count("*").alias("frames"), F.sum("length").alias("bytes"), F.max("sample_rate").alias("sample_rate"))


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS at, event_type <> 'error' AS ok FROM events), d AS (SELECT user_id,
  count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failures FROM e GROUP BY 1) SELECT user_id, calls, failures, calls AS delivered FROM d"""
)
def delivery_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11.4, 2.4.9: a transport of any name is a destination: every segment reaches it, failures are counted."""
    e = events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    targets = spark.createDataFrame([("own",)], "destination string")
    f = transport.fan_out(e.select("user_id", "event_id", "ok"), targets)
    return f.groupBy("user_id").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"),
        F.count_if(F.col("destination") == "own").alias("delivered")
    )
