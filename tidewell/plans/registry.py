"""Registered queries over the driver's tables, each with DuckDB SQL that computes the same another way.

events stand for frames, pushes and transport events of the stream user_id; lineitem for segments of
the playlist l_orderkey; embeddings for PCM blocks; part, supplier, customer and nation for variants,
destinations and renditions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import text as T
from ..operators import audio, intervals, media, playlists, segmenter, transport
from ..operators.patterns import as_of, running_sum

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events cut into live segments: keyframes are views, target 60, at most 90."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    return segmenter.assign_segments(e, ["user_id"], ["event_id"], "value", F.col("event_type") == "view", 60.0, 90.0)


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmenter.build_segments(frames(spark, sf_dir), ["user_id"], "event_id", "value", F.col("event_type") == "view", F.col("event_type"))


#: Cuts each user's events row by row: seg is this frame's segment, nxt, acc and cnt what it leaves.
LIVE_SQL = """
WITH RECURSIVE e AS (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (
  SELECT user_id, event_id, value, event_type, i, 0 AS seg,
    CASE WHEN NOT (value >= 60 AND event_type = 'view') AND value >= 90 AND false THEN 1 ELSE 0 END AS nxt, value AS acc, 1 AS cnt
  FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.value, e.event_type, e.i,
    CASE WHEN f.acc + e.value >= 60 AND e.event_type = 'view' THEN f.nxt + (CASE WHEN f.cnt > 0 THEN 1 ELSE 0 END) ELSE f.nxt END,
    CASE WHEN f.acc + e.value >= 60 AND e.event_type = 'view' THEN f.nxt + (CASE WHEN f.cnt > 0 THEN 1 ELSE 0 END)
         WHEN f.acc + e.value >= 90 AND f.cnt > 0 THEN f.nxt + 1 ELSE f.nxt END,
    CASE WHEN f.acc + e.value >= 60 AND e.event_type = 'view' THEN e.value WHEN f.acc + e.value >= 90 AND f.cnt > 0 THEN 0 ELSE f.acc + e.value END,
    CASE WHEN f.acc + e.value >= 60 AND e.event_type = 'view' THEN 1 WHEN f.acc + e.value >= 90 AND f.cnt > 0 THEN 0 ELSE f.cnt + 1 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1),
s AS (SELECT user_id, seg AS segment_index, count(*) AS frames, sum(value) AS duration, min(event_id) AS first_frame, max(event_id) AS last_frame,
  arg_min(event_type, event_id) = 'view' AS independent, list_sort(list(DISTINCT event_type)) AS codecs FROM f GROUP BY 1, 2)
"""


@query(
    LIVE_SQL + "SELECT user_id, segment_index, frames, round(duration, 6) AS duration, first_frame, last_frame, independent, array_to_string(codecs, ',') AS codecs FROM s"
)
def live_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.1, 2.6.2, 2.6.4, 2.8.3: live segmenter and segment build."""
    return live(spark, sf_dir).select(
        "user_id", "segment_index", "frames", F.round("duration", 6).alias("duration"), "first_frame", "last_frame", "independent",
        F.array_join("codecs", ",").alias("codecs")
    )


DECIMAL_SQL = "regexp_replace(printf('%.3f', {0}), '(\\.\\d+?)0+$', '\\1')"


@query(LIVE_SQL + f""", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY segment_index DESC) AS k FROM s),
c AS (SELECT user_id, count(*) FILTER (WHERE k > 5) AS media_sequence, count(*) FILTER (WHERE k > 5 AND NOT independent) AS ds FROM r GROUP BY 1),
b AS (SELECT user_id, ceil(max(round(duration, 6)))::BIGINT AS target,
  string_agg(CASE WHEN NOT independent THEN '#EXT-X-DISCONTINUITY' || chr(10) ELSE '' END || '#EXTINF:' || {DECIMAL_SQL.format('round(duration, 6)')}
  || ',' || chr(10) || 'segment_' || segment_index || '.m4s' || chr(10), '' ORDER BY segment_index) AS body
  FROM r WHERE k <= 5 GROUP BY 1)
SELECT user_id, media_sequence, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || target || chr(10)
  || '#EXT-X-MEDIA-SEQUENCE:' || media_sequence || chr(10)
  || CASE WHEN ds > 0 THEN '#EXT-X-DISCONTINUITY-SEQUENCE:' || ds || chr(10) ELSE '' END || body AS m3u8 FROM b JOIN c USING (user_id)""")
def live_playlist_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.22–2.6.24, 2.2.31, 2.2.28, 2.5.12: the playlist of each stream's last five segments."""
    segments = live(spark, sf_dir).withColumn("duration", F.round("duration", 6))
    return playlists.render_live(
        segments, ["user_id"], "segment_index", "duration", T.file_name(F.lit("segment_%d.m4s"), F.col("segment_index")),
        discontinuity=~F.col("independent")
    )


@query("""SELECT user_id, event_id, min(event_id) OVER w AS first_index, greatest(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 5,
  0)::BIGINT AS media_sequence,
  ceil(max(value) OVER w)::BIGINT AS target_duration, round(sum(value) OVER w, 6) AS total_duration
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def sliding_window_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.24, 2.5.11, 2.10.4."""
    return playlists.sliding_state(load(spark, sf_dir, "events"), ["user_id"], "event_id", "value")


@query("""SELECT user_id, count(*) AS retained, min(event_id) AS first_index, round(sum(value), 6) AS total_duration
FROM (SELECT *, epoch_us(ts) / 1000000 AS t_at, max(epoch_us(ts) / 1000000) OVER (PARTITION BY user_id) AS newest FROM events)
  WHERE t_at + value >= newest - 604800 GROUP BY 1""")
def dvr_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.25, 2.5.8, 2.10.5: a week of segments."""
    e = events(spark, sf_dir).withColumn("at", F.col("us") / 1_000_000)
    kept = playlists.dvr_window(e, ["user_id"], "at", "value", 604800.0)
    return kept.groupBy("user_id").agg(
        F.count("*").alias("retained"), F.min("event_id").alias("first_index"), F.round(F.sum("value"), 6).alias("total_duration")
    )


@query("""WITH n AS (SELECT *, epoch_us(ts) / 1000000 AS t_at, max(epoch_us(ts) / 1000000) OVER (PARTITION BY user_id) AS newest FROM events),
s AS (SELECT user_id, coalesce(min(event_id) FILTER (WHERE t_at >= newest - 259200), min(event_id)) AS start FROM n GROUP BY 1)
SELECT user_id, event_id FROM (SELECT n.user_id, event_id, row_number() OVER (PARTITION BY n.user_id ORDER BY event_id) AS k FROM n
  JOIN s USING (user_id) WHERE event_id >= start) WHERE k <= 4""")
def dvr_offset_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.3.43, 2.7.4, 2.10.6: four segments from three days back (the limit is the feature)."""
    e = events(spark, sf_dir).withColumn("at", F.col("us") / 1_000_000)
    return playlists.read_from_offset(e, ["user_id"], "event_id", "at", -259200.0, 4).select("user_id", "event_id")


@query("""SELECT user_id, count(*) FILTER (WHERE k > 5) AS media_sequence, count(*) FILTER (WHERE k > 5
  AND event_type = 'error') AS discontinuity_sequence
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) GROUP BY 1""")
def discontinuity_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.22, 2.6.23."""
    return playlists.sequences(load(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "error")


@query("""SELECT user_id, event_id, round(coalesce(sum(value) OVER w, 0), 6) AS start_offset, (row_number() OVER o - 1) % 10 = 0 AS emit_date,
  strftime(make_timestamp(1704067200000000 + (round(coalesce(sum(value) OVER w, 0), 3) * 1000)::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S.%g')
  || 'Z' AS program_date_time
FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id), w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING)""")
def program_date_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.19–2.6.21, 2.2.12, 2.9.7: wall clock of each segment, written out for every tenth."""
    e = running_sum(load(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value"), "off", 4096)
    e = running_sum(e, ["user_id"], "event_id", F.lit(1), "i", 4096)
    us = F.lit(1704067200000000) + (F.round("off", 3) * 1000).cast("decimal(20,0)").cast("long") * 1000
    return e.select(
        "user_id", "event_id", F.round("off", 6).alias("start_offset"), playlists.emit_date(F.col("i"), "interval", 10).alias("emit_date"),
        T.iso8601(us).alias("program_date_time")
    )


@query("""SELECT user_id, event_id, (value * 100)::BIGINT AS length, coalesce(sum((value * 100)::BIGINT) OVER (PARTITION BY user_id
  ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset,
  (value * 100)::BIGINT || '@' || coalesce(sum((value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0)::BIGINT AS byte_range FROM events""")
def byte_range_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.17, 2.6.18, 2.2.9."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("length"))
    out = running_sum(e, ["user_id"], "event_id", F.col("length"), "byte_offset", 4096)
    return out.withColumn("byte_range", F.concat(F.col("length").cast("string"), F.lit("@"), F.col("byte_offset").cast("string")))


@query("""SELECT user_id, count(*) FILTER (WHERE run <= total - 36) AS skipped_segments FROM (SELECT user_id,
  sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run, sum(value) OVER (PARTITION BY user_id) AS total
  FROM events) GROUP BY 1""")
def delta_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.31, 2.6.32, 2.10.9, 2.9.31."""
    return playlists.skipped(load(spark, sf_dir, "events"), ["user_id"], "event_id", "value", F.lit(36.0), 4096)


@query("SELECT l_orderkey, ceil(max(l_quantity))::BIGINT AS target_duration FROM lineitem GROUP BY 1")
def target_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5.11, 2.5.12, 2.5.14."""
    return playlists.target_duration(load(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity")


@query("""SELECT l_orderkey, count(*) AS segments, min(l_linenumber) AS first_index, max(l_linenumber) AS last_index, round(sum(l_quantity),
  6) AS total_duration,
  sum((l_extendedprice * 100)::BIGINT)::BIGINT AS total_bytes, round(avg(l_quantity), 6) AS average_duration,
  floor(round(sum((l_extendedprice * 100)::BIGINT) * 8 / sum(l_quantity), 6))::BIGINT AS bitrate FROM lineitem GROUP BY 1""")
def playlist_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5.1, 2.5.2, 2.5.8–2.5.10, 2.5.13, 2.5.15."""
    rows = load(spark, sf_dir, "lineitem").withColumn("bytes", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return playlists.totals(rows, ["l_orderkey"], "l_linenumber", "l_quantity", "bytes")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, event_type = 'view' AS sync, row_number() OVER (PARTITION BY user_id
  ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_id, value, i, CASE WHEN sync THEN 0 ELSE -1 END AS seg, value AS held FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.value, e.i, CASE WHEN e.sync AND (f.seg < 0 OR f.held >= 100) THEN f.seg + 1 ELSE f.seg END,
    CASE WHEN e.sync AND (f.seg < 0 OR f.held >= 100) THEN e.value ELSE f.held + e.value END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, seg AS segment_index, min(event_id) AS first_sample, count(*) AS samples, round(sum(value), 6) AS duration FROM f WHERE seg >= 0
  GROUP BY 1, 2""")
def vod_cut_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.7, 2.6.8: VOD cutting at sync samples."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    cut = segmenter.vod_cuts(e, ["user_id"], "event_id", "value", F.col("event_type") == "view", 100.0)
    return cut.groupBy("user_id", "segment_index").agg(
        F.min("event_id").alias("first_sample"), F.count("*").alias("samples"), F.round(F.sum("value"), 6).alias("duration")
    )


@query("""WITH r AS (SELECT l_orderkey % 500 AS track, row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_orderkey, l_linenumber, l_partkey,
  l_suppkey, l_extendedprice) AS run, l_quantity::BIGINT % 5 AS n, 1000 + l_linenumber AS delta FROM lineitem),
s AS (SELECT track, run, delta, unnest(range(0, n)) AS i FROM r)
SELECT track, (row_number() OVER w - 1)::BIGINT AS sample, coalesce(sum(delta) OVER (PARTITION BY track ORDER BY run,
  i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS dts, delta::BIGINT AS delta
FROM s WINDOW w AS (PARTITION BY track ORDER BY run, i)""")
def sample_decode_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.9, 2.6.11: run-length table to samples with decode times."""
    li = load(spark, sf_dir, "lineitem").withColumn("track", F.col("l_orderkey") % 500)
    numbered = running_sum(
        li, ["track"], "l_orderkey", F.lit(1).cast("long"), "run", 4096, inclusive=True,
        ties=("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    )
    runs = numbered.select("track", "run", (F.col("l_quantity").cast("long") % 5).alias("n"), (F.col("l_linenumber") + 1000).alias("delta"))
    return media.decode_times(runs, ["track"], "run", "n", "delta")


@query("""WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), v AS (SELECT user_id, us AS b, us + 86400000000 AS e FROM e
  WHERE event_type = 'view'), a AS (SELECT user_id, event_id, us FROM e WHERE event_type = 'click')
SELECT v.user_id, v.b AS begin_us, v.e AS end_us, min(event_id) AS first_sample, max(event_id) AS last_sample, count(*) AS samples FROM v
  JOIN a ON a.user_id = v.user_id AND a.us >= v.b AND a.us < v.e GROUP BY 1, 2, 3""")
def audio_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.4.1, 2.4.2: audio samples inside video segments, by a bucketed range join."""
    e = events(spark, sf_dir)
    video = e.where("event_type = 'view'").select("user_id", F.col("us").alias("begin_us"), (F.col("us") + 86_400_000_000).alias("end_us"))
    sound = e.where("event_type = 'click'").select("user_id", "event_id", "us")
    return segmenter.align_audio(video, sound, ["user_id"], "begin_us", "end_us", "us", "event_id", 86_400_000_000.0)


@query(
    """SELECT s.user_id, s.event_id, k.event_id AS sync_id FROM (SELECT * FROM events WHERE event_type <> 'view') s ASOF LEFT JOIN (SELECT *
  FROM events WHERE event_type = 'view') k ON s.user_id = k.user_id AND s.event_id >= k.event_id"""
)
def as_of_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.4.3–2.4.5, 2.4.7: the last sync event before each other event."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("sync_id"))
    return as_of(e.where("event_type <> 'view'").select("user_id", "event_id"), right, ["user_id"], "event_id", "sync_id", ["sync_id"], 4096)


@query(
    """SELECT user_id, event_id, coalesce(max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id),
  min(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id), event_id) AS nearest_sync FROM events"""
)
def nearest_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.4.5, 2.6.16."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return media.nearest_sync(e, ["user_id"], "event_id", F.col("event_type") == "view", 4096).drop("event_type")


@query(
    """SELECT user_id, us, kind, row_number() OVER (PARTITION BY user_id ORDER BY us, kind DESC) AS position FROM (SELECT user_id,
  epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 'video' ELSE 'audio' END AS kind FROM events WHERE event_type IN ('view', 'click'))"""
)
def ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.4.6: video and audio in presentation order."""
    e = events(spark, sf_dir)
    take = lambda t: e.where(F.col("event_type") == t).select("user_id", "us")
    return segmenter.interleaved(take("view"), take("click"), ["user_id"], "us", 86_400_000_000)


BANDWIDTH_SQL = """WITH b AS (SELECT user_id, event_id, sum((value * 1000)::BIGINT) OVER w * 8 / sum(greatest(value / 10, 0.001)) OVER w AS bps
FROM (SELECT *, epoch_us(ts) AS us FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 172800000000 PRECEDING
  AND CURRENT ROW))"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("bytes", F.round(F.col("value") * 1000).cast("long"))
    return transport.bandwidth(e, ["user_id"], F.col("us"), "bytes", F.col("value") / 10, 172_800.0)


@query(BANDWIDTH_SQL + "SELECT user_id, event_id, round(bps, 4) AS bps FROM b")
def bandwidth_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5.22, 2.6.40, 2.10.12: bits a second over a trailing two days."""
    return measured(spark, sf_dir).select("user_id", "event_id", F.round("bps", 4).alias("bps"))


@query("""WITH b AS (SELECT user_id, event_id, sum(bytes) OVER w * 8 / sum(secs) OVER w AS bps FROM (SELECT *, epoch_us(ts) AS us,
  (value * 1000)::BIGINT AS bytes, greatest((props::JSON->>'k')::BIGINT, 0.001) AS secs FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN bps / 8000 < 0.5 THEN 'critical' WHEN bps / 8000 < 0.9 THEN 'insufficient' ELSE 'normal' END AS state,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM b),
l AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY event_id), 'normal') AS before FROM s WHERE n >= 3)
SELECT user_id, event_id, state FROM l WHERE state <> before""")
def bandwidth_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.39: changes of the alert state."""
    e = events(spark, sf_dir).withColumn("bytes", F.round(F.col("value") * 1000).cast("long"))
    m = transport.bandwidth(e, ["user_id"], F.col("us"), "bytes", F.get_json_object("props", "$.k").cast("long"), 172_800.0)
    return transport.bandwidth_alerts(m, ["user_id"], "event_id", F.lit(8000.0), bucket=4096).select("user_id", "event_id", "state")


GRADE_SQL = "CASE WHEN {0} > 0.9 THEN 'excellent' WHEN {0} > 0.7 THEN 'good' WHEN {0} > 0.5 THEN 'fair' WHEN {0} > 0.3 THEN 'poor' ELSE 'critical' END"


@query(f"SELECT event_id, {GRADE_SQL.format('(props::JSON->>chr(107))::BIGINT / 100')} AS grade FROM events")
def quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.27, 2.7.6."""
    return load(spark, sf_dir, "events").select("event_id", M.grade(F.get_json_object("props", "$.k").cast("long") / 100).alias("grade"))


@query(f"""WITH g AS (SELECT s_nationkey, CASE WHEN s_suppkey % 10 = 0 THEN 'critical' WHEN s_suppkey % 10 = 1 THEN coalesce(g0, 'poor')
  ELSE coalesce(g0, 'good') END AS g
  FROM (SELECT *, CASE WHEN s_acctbal >= 0 THEN {GRADE_SQL.format('s_acctbal / 10000')} END AS g0 FROM supplier)),
o AS (SELECT s_nationkey, g, CASE g WHEN 'critical' THEN 0 WHEN 'poor' THEN 1 WHEN 'fair' THEN 2 WHEN 'good' THEN 3 ELSE 4 END AS k FROM g)
SELECT s_nationkey, count(*) FILTER (WHERE g IN ('excellent', 'good')) AS healthy, count(*) FILTER (WHERE g IN ('fair', 'poor')) AS degraded,
  count(*) FILTER (WHERE g = 'critical') AS failed, arg_min(g, k) AS overall FROM o GROUP BY 1""")
def health_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5.5, 2.5.6, 2.7.6."""
    s = load(spark, sf_dir, "supplier")
    state = F.when(F.col("s_suppkey") % 10 == 0, "failed").when(F.col("s_suppkey") % 10 == 1, "connecting").otherwise("connected")
    g = M.effective_grade(state, F.when(F.col("s_acctbal") >= 0, M.grade(F.col("s_acctbal") / 10000)))
    return transport.dashboard(s.withColumn("g", g), ["s_nationkey"], "g")


@query("""WITH d AS (SELECT user_id, event_id, CASE WHEN value < 20 THEN 'decrease' WHEN value > 60 THEN 'increase' ELSE 'maintain' END AS direction
  FROM events),
r AS (SELECT *, sum(CASE WHEN direction IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *,
  lag(direction) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM d))
SELECT user_id, event_id, direction FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS k FROM r) WHERE k % 2 = 0""")
def abr_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.41: after two like recommendations in a row."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "value")
    d = F.when(F.col("value") < 20, "decrease").when(F.col("value") > 60, "increase").otherwise("maintain")
    return transport.abr_adjustments(e, ["user_id"], "event_id", d, 2, 4096).drop("value")


@query("""WITH r AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
n AS (SELECT user_id, event_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, run ORDER BY event_id) AS n FROM r)
SELECT user_id, event_id, (CASE WHEN n > 0 THEN least(n - 1, 2) END)::INT AS active_backup FROM n""")
def failover_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.50, 2.6.51, 2.4.14."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return transport.failover(
        e, ["user_id"], "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase", F.lit(3), 4096
    ).drop("event_type")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS t, event_type <> 'error' AS ok,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, 'closed' AS breaker, true AS allowed, CASE WHEN ok THEN 0 ELSE 1 END AS n, NULL::DOUBLE AS opened FROM e
  WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i,
    CASE WHEN f.opened IS NULL THEN 'closed' WHEN e.t - f.opened < 86400 THEN 'open' ELSE 'half_open' END,
    f.opened IS NULL OR e.t - f.opened >= 86400,
    CASE WHEN f.opened IS NOT NULL AND e.t - f.opened < 86400 THEN f.n WHEN e.ok THEN 0 ELSE f.n + 1 END,
    CASE WHEN f.opened IS NOT NULL AND e.t - f.opened < 86400 THEN f.opened WHEN e.ok THEN NULL WHEN f.opened IS NULL AND f.n + 1 >= 2 THEN e.t
  ELSE f.opened END
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, breaker, allowed FROM f""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.52: opens at two failures in a row, half opens a day later."""
    e = events(spark, sf_dir).select("user_id", "event_id", (F.col("us") / 1_000_000).alias("t"), (F.col("event_type") != "error").alias("ok"))
    return transport.circuit_breaker(e, ["user_id"], ["event_id"], "t", "ok", 2, 86400.0).drop("t", "ok")


@query(
    """SELECT n_nationkey, least(1.0 * pow(2.0, n_nationkey % 8), 30.0) AS standard, least(0.5 * pow(1.5, n_nationkey % 8), 10.0) AS aggressive,
  least(2.0 * pow(3.0, n_nationkey % 8), 60.0) AS conservative FROM nation"""
)
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.28."""
    a = F.col("n_nationkey") % 8
    return load(spark, sf_dir, "nation").select(
        "n_nationkey",
        *[
            M.backoff(a, *M.RETRY[p][1:]).alias(n) for p,
            n in (("default", "standard"), ("aggressive", "aggressive"), ("conservative", "conservative"))
        ]
    )


@query(
    """SELECT user_id, event_id, sum(CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
  ORDER BY event_id ROWS 2 PRECEDING) = 3 AS alert FROM events"""
)
def gap_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.49, 2.3.49."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return playlists.gap_alerts(e, ["user_id"], "event_id", F.col("event_type").isin("error", "signup")).drop("event_type")


@query("""WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value / 1000 AS rms FROM events),
s AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run, 20 * log10(rms) AS db FROM x WHERE 20 * log10(rms) < -30)
SELECT user_id, round(min(i) * 0.5::DOUBLE, 6) AS start, round((max(i) + 1) * 0.5::DOUBLE, 6) AS "end",
  round((max(i) + 1) * 0.5::DOUBLE - min(i) * 0.5::DOUBLE, 6) AS duration, round(avg(db), 6) AS mean_db FROM s GROUP BY user_id,
  run HAVING (max(i) + 1) * 0.5::DOUBLE - min(i) * 0.5::DOUBLE >= 1.0""")
def silence_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.33: runs of quiet windows."""
    e = running_sum(
        load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 1000).alias("rms")), ["user_id"], "event_id",
        F.lit(1).cast("long"), "i", 4096
    )
    out = audio.silence(e, ["user_id"], "i", "rms", 0.5, 1.0, -30.0)
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("start", "end", "duration", "mean_db")])


EDGE = "e[greatest(1, least(len(e), i + {0}))]"
Y = [EDGE.format(k) for k in (-1, 0, 1, 2)]
CUBIC = "abs((({3}) - ({2}) - ({0}) + ({1})) * pow({{t}}, 3) + (({0}) - ({1}) - (({3}) - ({2}) - ({0}) + ({1}))) * pow({{t}}, 2) + (({2}) - ({0})) * {{t}} + ({1}))".format(*Y)


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i
  FROM v)
SELECT vec_id, round(sqrt(avg(e[i] * e[i])), 6) AS rms, round(max(abs(e[i])), 6) AS peak, round(max(greatest(abs(e[i]), {CUBIC.format(t=0.25)},
  {CUBIC.format(t=0.5)}, {CUBIC.format(t=0.75)})), 6) AS true_peak,
  round(20 * log10(sqrt(avg(e[i] * e[i]))), 6) AS rms_db FROM x GROUP BY 1""")
def audio_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5.18, 2.5.19, 2.6.38, 2.9.37: RMS, peak and true peak of each block."""
    out = audio.block_levels(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("rms", "peak", "true_peak")], F.round(M.decibels(F.col("rms")), 6).alias("rms_db"))


LISTS = "list_aggregate(list_transform({0}, lambda x: printf('%.4f', x + 0.0)), 'string_agg', ' ')"


def digits(column: str) -> object:
    """An array of doubles as text, four decimals each."""
    return F.array_join(F.transform(F.col(column), lambda x: F.format_string("%.4f", x.cast("double") + 0.0)), " ")


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i
  FROM v),
m AS (SELECT vec_id, any_value(e) AS e, 20 * log10(sqrt(avg(e[i] * e[i]))) AS db, 20 * log10(max(greatest(abs(e[i]), {CUBIC.format(t=0.25)},
  {CUBIC.format(t=0.5)}, {CUBIC.format(t=0.75)}))) AS tp FROM x GROUP BY 1),
g AS (SELECT vec_id, e, -16 - db - greatest(0, tp + (-16 - db) + 1) AS gain FROM m)
SELECT vec_id, round(list_aggregate(list_transform(e, lambda x: abs(greatest(-1, least(1, x * pow(10, gain / 20))))), 'sum'), 6) AS total,
  round(list_aggregate(list_transform(e, lambda x: greatest(-1, least(1, x * pow(10, gain / 20)))), 'max'), 6) AS most FROM g""")
def normalise_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.39, 2.9.40, 2.11.11: blocks brought to -16 dB with true peaks under -1 dB."""
    e = F.col("embedding")
    v = load(spark, sf_dir, "embeddings").withColumn("a", M.normalise(e, M.decibels(M.rms(e)), M.LOUDNESS["podcast"]))
    return v.select(
        "vec_id", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("total"),
        F.round(F.array_max("a"), 6).alias("most")
    )


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, {LISTS.format('list_transform(range(1, len(e) + 1, 2), lambda i: (e[i] + e[i + 1]) / 2)')} AS mono,
  {LISTS.format('flatten(list_transform(range(0, len(e) // 6), lambda f: [greatest(-1, least(1, e[6*f+1] + e[6*f+3] * sqrt(0.5) + e[6*f+5] * sqrt(0.5))), greatest(-1, least(1, e[6*f+2] + e[6*f+3] * sqrt(0.5) + e[6*f+6] * sqrt(0.5)))]))')} AS stereo FROM v""")
def channel_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.54, 2.9.56, 2.9.57: stereo to mono, 5.1 to stereo."""
    e = F.col("embedding")
    v = load(spark, sf_dir, "embeddings").select(
        "vec_id", M.stereo_to_mono(F.transform(e, lambda x: x.cast("double"))).alias("a"), M.mix(e, M.SURROUND_51).alias("b")
    )
    return v.select("vec_id", digits("a").alias("mono"), digits("b").alias("stereo"))


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, {LISTS.format('list_transform(range(0, ceil(len(e) * 44100.0 / 48000)::BIGINT), lambda i: e[least(len(e), floor(i * (48000.0::DOUBLE / 44100.0::DOUBLE))::BIGINT + 1)] + (e[least(len(e), floor(i * (48000.0::DOUBLE / 44100.0::DOUBLE))::BIGINT + 2)] - e[least(len(e), floor(i * (48000.0::DOUBLE / 44100.0::DOUBLE))::BIGINT + 1)]) * (i * (48000.0::DOUBLE / 44100.0::DOUBLE) - floor(i * (48000.0::DOUBLE / 44100.0::DOUBLE))))')} AS samples FROM v""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.54, 2.9.59, 2.9.61: 48 to 44.1 kHz."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", M.resample_linear(F.col("embedding"), 48000, 44100).alias("a"))
    return v.select("vec_id", digits("a").alias("samples"))


@query(f"""WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: trunc(greatest(-1, least(1, x)) * 32767)::INT) AS s
  FROM embeddings)
SELECT vec_id, array_to_string(s, ' ') AS int16, {LISTS.replace('%.4f', '%.15f').format('list_transform(s, lambda x: x / 32768.0)')} AS back,
  array_to_string(list_concat(list_transform(range(1, len(s) + 1, 2), lambda i: s[i]), list_transform(range(2, len(s) + 1, 2), lambda i: s[i])),
  ' ') AS planar FROM v""")
def pcm_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.41, 2.9.42, 2.9.47: float to int16 and back, planes."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", M.float_to_int16(F.col("embedding")).alias("s"))
    return v.select(
        "vec_id", F.array_join(F.transform("s", lambda x: x.cast("string")), " ").alias("int16"),
        F.array_join(F.transform(M.int16_to_float(F.col("s")), lambda x: F.format_string("%.15f", x.cast("double") + 0.0)), " ").alias("back"),
        F.array_join(F.transform(F.flatten(M.deinterleave(F.col("s"), 2)), lambda x: x.cast("string")), " ").alias("planar")
    )


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i
  FROM events),
f AS (SELECT user_id, event_id, i, t AS last, 0 AS ep FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t - f.last >= 200000 THEN e.t ELSE f.last END, CASE
  WHEN e.t - f.last >= 200000 THEN f.ep + 1 ELSE f.ep END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, ((i - 1) // 10)::INT AS epoch_by_count, ep AS epoch_by_time, (i - 1) % 10 = 0 AS key_tag FROM f""")
def key_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.43–2.6.45, 2.10.21, 2.5.23: keys by count and by elapsed time."""
    e = events(spark, sf_dir).select("user_id", "event_id", (F.col("us") / 1_000_000).alias("t"))
    e = running_sum(e, ["user_id"], "event_id", F.lit(1).cast("long"), "i", 4096)
    e = intervals.epochs_every(e, F.col("i"), 10).withColumnRenamed("key_epoch", "epoch_by_count")
    e = intervals.epochs_elapsed(e, ["user_id"], "event_id", "t", 200_000.0).withColumnRenamed("key_epoch", "epoch_by_time")
    return e.select("user_id", "event_id", "epoch_by_count", "epoch_by_time", (F.col("i") % 10 == 0).alias("key_tag"))


@query("SELECT event_id, '0x' || lpad(lower(to_hex(event_id)), 32, '0') AS iv FROM events")
def derived_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.62."""
    return load(spark, sf_dir, "events").select("event_id", M.iv_hex(F.col("event_id")).alias("iv"))


KIND_SQL = "CASE event_type WHEN 'view' THEN 'open' WHEN 'purchase' THEN 'close' WHEN 'error' THEN 'expire' WHEN 'click' THEN 'update' ELSE 'none' END"


@query(f"""WITH e AS (SELECT user_id, event_id AS o, {KIND_SQL} AS k, epoch_us(ts) AS t_at FROM events),
p AS (SELECT user_id, min(o) AS f, max(o) AS l, arg_max(t_at, o) AS start_us FROM e WHERE k = 'open' GROUP BY 1),
j AS (SELECT p.user_id, start_us, f, arg_max(t_at, o) FILTER (WHERE k = 'close' AND o > l) AS end_us, max(o) FILTER (WHERE k = 'close'
  AND o > l) AS co, max(o) FILTER (WHERE k = 'expire' AND o > l) AS eo,
  count(*) FILTER (WHERE k = 'update' AND o > f) AS updates FROM p JOIN e USING (user_id) GROUP BY 1, 2, 3)
SELECT user_id, start_us, end_us, CASE WHEN co IS NULL THEN 'open' WHEN eo > co THEN 'expired' ELSE 'closed' END AS state, updates FROM j""")
def interval_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10.13–2.10.17: date ranges opened, updated, closed, expired."""
    kind = F.element_at(
        F.create_map(*[F.lit(x) for x in ("view", "open", "purchase", "close", "error", "expire", "click", "update", "signup", "none")]),
        F.col("event_type")
    )
    out = intervals.lifecycle(events(spark, sf_dir), ["user_id"], "event_id", kind, F.col("us"))
    return out.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "state", "updates")


@query("""WITH RECURSIVE c AS (SELECT user_id, a, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a), total) AS b,
  row_number() OVER (PARTITION BY user_id ORDER BY a) AS i
  FROM (SELECT user_id, (epoch_us(ts) // 1000000)::DOUBLE AS a, max((epoch_us(ts) // 1000000)::DOUBLE) OVER (PARTITION BY user_id) + 600 AS total
  FROM events WHERE event_type = 'view')),
f AS (SELECT user_id, i, a, b, 0 AS n FROM c WHERE i = 1
  UNION ALL SELECT c.user_id, c.i, CASE WHEN f.b - f.a < 50000 OR c.b - c.a < 50000 THEN f.a ELSE c.a END, c.b, CASE WHEN f.b - f.a < 50000
  OR c.b - c.a < 50000 THEN f.n ELSE f.n + 1 END FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1)
SELECT user_id, n AS chapter, min(a) AS start, arg_max(b, i) AS "end" FROM f GROUP BY 1, 2""")
def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.46–2.6.48, 2.7.1, 2.8.4: ends filled in, short chapters merged."""
    e = events(spark, sf_dir).where("event_type = 'view'").select("user_id", F.floor(F.col("us") / 1_000_000).cast("double").alias("a"))
    total = e.groupBy("user_id").agg((F.max("a") + 600).alias("total"))
    c = intervals.chapter_ends(
        e.join(total, "user_id"), ["user_id"], "a", F.lit(None).cast("double"), F.col("total")
    ).select("user_id", "a", "chapter_end")
    return intervals.merge_short(c, ["user_id"], "a", "chapter_end", 50_000.0).select("user_id", "chapter", "start", "end")


@query("""WITH r AS (SELECT user_id, event_id // 200 AS seg, event_id, max(event_id // 200) OVER (PARTITION BY user_id) AS top,
  row_number() OVER (PARTITION BY user_id, event_id // 200 ORDER BY event_id) - 1 AS p FROM events)
SELECT user_id, event_id, seg::BIGINT AS segment, p::INT AS part_index, seg > top - 3 AS retained, (seg + CASE WHEN p + 1 >= 3 THEN 1
  ELSE 0 END)::BIGINT AS hint_segment, (CASE WHEN p + 1 >= 3 THEN 0 ELSE p + 1 END)::INT AS hint_part FROM r""")
def partial_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.28–2.6.30, 2.10.7: parts, retention, preload hints."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 200).cast("long").alias("segment"))
    return playlists.parts(e, ["user_id"], "segment", "event_id", 3, 3)


@query("""WITH p AS (SELECT user_id, event_id // 100 AS msn, min(epoch_us(ts) / 1000000) AS ready FROM events WHERE event_type <> 'click' GROUP BY 1,
  2),
q AS (SELECT user_id, event_id, event_id // 100 + 1 AS msn, epoch_us(ts) / 1000000 AS t_at FROM events WHERE event_type = 'click'),
j AS (SELECT q.user_id, event_id, t_at, (SELECT min(ready) FROM p WHERE p.user_id = q.user_id AND p.msn >= q.msn) AS ready, EXISTS (SELECT 1 FROM p
  WHERE p.user_id = q.user_id AND p.msn = q.msn) AS known FROM q)
SELECT user_id, event_id, round(CASE WHEN NOT known OR greatest(0, ready - t_at) > 86400 THEN 86400.0 ELSE greatest(0, ready - t_at) END, 4) AS wait,
  NOT known OR greatest(0, ready - t_at) > 86400 AS timed_out FROM j""")
def blocking_reload_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10.10, 2.10.11, 2.3.50: waits of blocking requests until their segment is there."""
    e = events(spark, sf_dir).withColumn("at", F.col("us") / 1_000_000).withColumn("msn", F.floor(F.col("event_id") / 100).cast("long"))
    requests = e.where("event_type = 'click'").select("user_id", "event_id", "at", (F.col("msn") + 1).alias("msn"))
    done = e.where("event_type <> 'click'").select("user_id", "msn", F.col("at").alias("ready"))
    out = playlists.blocking_wait(requests, done, ["user_id"], "at", "ready", "msn", 86400.0)
    return out.select("user_id", "event_id", F.round("wait", 4).alias("wait"), "timed_out")


@query("""SELECT user_id, event_id, ((row_number() OVER w - 1) // 12)::INT AS sheet, ((row_number() OVER w - 1) % 4)::INT AS tile_column,
  (((row_number() OVER w - 1) // 4) % 3)::INT AS tile_row,
  round(coalesce(sum(coalesce(CASE WHEN event_type <> 'error' THEN value END, 6.0)) OVER (PARTITION BY user_id
  ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start FROM events WINDOW w AS (PARTITION BY user_id
  ORDER BY event_id)""")
def tile_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.6.53, 2.2.46: thumbnails in 4 x 3 sheets."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("d"))
    return playlists.tile_layout(e, ["user_id"], "event_id", "d", 4, 3, 4096).withColumn("start", F.round("start", 6))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE event_type = 'error') AS failures,
  coalesce(sum((value * 1000)::BIGINT) FILTER (WHERE event_type <> 'error'), 0)::BIGINT AS bytes,
  round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS mean_latency, round(arg_max((value * 1000)::BIGINT / value,
  event_id) FILTER (WHERE event_type <> 'error'), 4) AS last_rate FROM events GROUP BY 1""")
def push_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5.3, 2.5.4."""
    e = load(spark, sf_dir, "events").withColumn("bytes", F.round(F.col("value") * 1000).cast("long"))
    out = transport.push_totals(e, ["user_id"], "event_id", "bytes", "value", F.col("event_type") != "error")
    return out.withColumn("mean_latency", F.round("mean_latency", 6)).withColumn("last_rate", F.round("last_rate", 4))


@query("""SELECT s_nationkey, bool_and(s_acctbal < 2000) AS all_failed, bool_or(s_acctbal < 2000) AS any_failed FROM supplier GROUP BY 1""")
def failover_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5.7, 2.4.10: when a push to several destinations counts as failed."""
    s = load(spark, sf_dir, "supplier")
    bad, first = F.col("s_acctbal") < 2000, F.col("s_suppkey") == 0
    a = transport.failure_policy(s, ["s_nationkey"], bad, first, "continue").withColumnRenamed("push_failed", "all_failed")
    return a.join(
        transport.failure_policy(s, ["s_nationkey"], bad, first, "require_all").withColumnRenamed("push_failed", "any_failed"),
        "s_nationkey"
    )


@query("""SELECT event_id, r_regionkey, value < 20 * (r_regionkey + 1) AS delivered FROM events, region""")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.4.9, 2.4.10: every segment to every destination (a checked small table)."""
    out = transport.fan_out(load(spark, sf_dir, "events").select("event_id", "value"), load(spark, sf_dir, "region").select("r_regionkey"))
    return out.select("event_id", "r_regionkey", (F.col("value") < 20 * (F.col("r_regionkey") + 1)).alias("delivered"))


@query("""SELECT p_partkey, (p_size * 40) // gcd(p_size * 40, 1080) || ':' || 1080 // gcd(p_size * 40, 1080) AS aspect, 'avc1.'
  || lpad(lower(to_hex(p_size)), 2, '0') || '00' || lpad(lower(to_hex((p_partkey % 52)::BIGINT)), 2, '0') AS codec,
  CASE WHEN p_size <= 4 THEN 'CC' ELSE 'SERVICE' END || p_size AS instream, CASE WHEN p_size * 40 > 1280 OR 720 > 720 THEN 1280
  ELSE p_size * 40 END AS width, CASE WHEN p_size * 40 > 1280 THEN least((p_retailprice * 1000)::BIGINT, 950000)
  ELSE (p_retailprice * 1000)::BIGINT END AS rate FROM part""")
def variant_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.19, 2.9.24, 2.9.82, 2.3.51, 2.3.52: aspect ratio, codec string, caption id, no upscaling."""
    p = load(spark, sf_dir, "part").withColumn("w", F.col("p_size") * 40).withColumn("r", F.round(F.col("p_retailprice") * 1000).cast("long"))
    s = M.scale_preset(F.lit(1280), F.lit(720), F.lit(950000).cast("long"), F.col("w"), F.lit(720), F.col("r"))
    return p.withColumn("s", s).select(
        "p_partkey", M.aspect_ratio(F.col("w"), F.lit(1080)).alias("aspect"),
        M.avc_codec(F.col("p_size"), F.lit(0), F.col("p_partkey") % 52).alias("codec"),
        M.instream_id(F.when(F.col("p_size") <= 4, "608").otherwise("708"), F.col("p_size")).alias("instream"),
        F.col("s.width").alias("width"), F.col("s.rate").alias("rate")
    )


@query(f"""SELECT event_id, {DECIMAL_SQL.format('value')} AS trimmed, printf('%02d:%02d:%02d.%03d', floor(value * 1000)::BIGINT // 3600000,
  floor(value * 1000)::BIGINT // 60000 % 60, floor(value * 1000)::BIGINT // 1000 % 60, floor(value * 1000)::BIGINT % 1000) AS vtt,
  printf('%02d:%02d:%02d.%03d', round(value * 1000)::BIGINT // 3600000, round(value * 1000)::BIGINT // 60000 % 60,
  round(value * 1000)::BIGINT // 1000 % 60, round(value * 1000)::BIGINT % 1000) AS ttml,
  replace(replace(props, '\\', '\\\\'), '"', '\\"') AS json, floor(value * 90000)::BIGINT AS pts FROM events""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.9.6, 2.9.9, 2.9.10, 2.9.13, 2.9.79, 2.2.28."""
    v = F.col("value")
    return load(spark, sf_dir, "events").select(
        "event_id", T.decimal(v).alias("trimmed"), T.vtt_time(v).alias("vtt"), T.ttml_time(v).alias("ttml"),
        T.json_escape(F.col("props")).alias("json"), M.pts(v).alias("pts")
    )
