"""Live playlists over many streams: windows, sequence numbers, dates, deltas, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .patterns import BUCKET, last_rows, running_sum, running_sums


def sliding_state(segments: DataFrame, keys: list[str], index: str, duration: str, size: int = 5, bucket: int = BUCKET) -> DataFrame:
    """The playlist after each segment: first and last index, MEDIA-SEQUENCE, target, total."""
    aggregates = {
        "first_index": lambda w: F.min(index).over(w), "_most": lambda w: F.max(duration).over(w),
        "_sum": lambda w: F.sum(duration).over(w)
    }
    s = last_rows(segments, keys, index, size, aggregates, bucket, "_i")
    return s.select(
        *keys, index, "first_index", F.greatest(F.col("_i") + 1 - size, F.lit(0)).cast("long").alias("media_sequence"),
        F.ceil("_most").cast("long").alias("target_duration"), F.round("_sum", 6).alias("total_duration")
    )


def last_segments(segments: DataFrame, keys: list[str], index: str, size: int = 5) -> DataFrame:
    """The last `size` of each stream, with evicted (how many came before)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(index))
    n = segments.groupBy(*keys).agg(F.count("*").alias("_n"))
    kept = segments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")
    return kept.join(n, keys).withColumn("evicted", F.greatest(F.col("_n") - size, F.lit(0))).drop("_n")


def sequences(segments: DataFrame, keys: list[str], index: str, discontinuity: Column, size: int = 5) -> DataFrame:
    """MEDIA-SEQUENCE and DISCONTINUITY-SEQUENCE of each stream's last `size` segments: how many were
    evicted, and how many of these began with a discontinuity. Totals less what is kept, so that a
    stream is summed by parts and only its last segments are ranked."""
    s = segments.withColumn("_d", F.coalesce(discontinuity, F.lit(False)))
    kept = last_segments(s, keys, index, size).groupBy(*keys).agg(F.count_if("_d").alias("_kept"))
    totals = s.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if("_d").alias("_all"))
    return totals.join(kept, keys).select(
        *keys, F.greatest(F.col("_n") - size, F.lit(0)).alias("media_sequence"),
        (F.col("_all") - F.col("_kept")).alias("discontinuity_sequence")
    )


def dvr_window(segments: DataFrame, keys: list[str], at: str, duration: str, window: float) -> DataFrame:
    """Segments of each stream that end within `window` of its newest start (kept while
    at + duration >= newest - window)."""
    newest = segments.groupBy(*keys).agg(F.max(at).alias("_newest"))
    return segments.join(newest, keys).where(F.col(at) + F.col(duration) >= F.col("_newest") - F.lit(window)).drop("_newest")


def read_from_offset(segments: DataFrame, keys: list[str], index: str, at: str, offset: float, most: int | None = None) -> DataFrame:
    """Segments from the first at or after newest + offset (offset is negative); from the first of all
    if there is none; at most `most`."""
    newest = segments.groupBy(*keys).agg(F.max(at).alias("_newest"))
    rows = segments.join(newest, keys)
    start = rows.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col(at) >= F.col("_newest") + F.lit(offset), F.col(index))), F.min(index)).alias("_start")
    )
    out = rows.join(start, keys).where(F.col(index) >= F.col("_start")).drop("_newest", "_start")
    if most is not None:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(index))).where(F.col("_r") <= most).drop("_r")
    return out


def emit_date(index: Column, policy: str, every: int = 1, discontinuity: Column | None = None) -> Column:
    """Whether a segment carries a PROGRAM-DATE-TIME: every segment, every n-th, or at the start and discontinuities."""
    if policy == "every":
        return F.lit(True)
    if policy == "interval":
        return index % every == 0
    return (index == 0) | F.coalesce(discontinuity if discontinuity is not None else F.lit(False), F.lit(False))


def skipped(segments: DataFrame, keys: list[str], index: str, duration: str, skip_until: Column, bucket: int = BUCKET) -> DataFrame:
    """How many leading segments a delta update leaves out: those that end `skip_until` or more before the end,
    in whole microseconds: sums of a stream come in another order each time."""
    run = running_sum(segments, keys, index, F.col(duration), "_run", bucket, inclusive=True)
    total = segments.groupBy(*keys).agg(F.sum(duration).alias("_total"))
    return run.join(total, keys).select(
        *keys, (F.round(F.col("_total") - F.col("_run"), 6) >= skip_until).alias("_s")
    ).groupBy(*keys).agg(F.count_if("_s").alias("skipped_segments"))


def target_duration(segments: DataFrame, keys: list[str], duration: str, default: int = 6) -> DataFrame:
    return segments.groupBy(*keys).agg(F.coalesce(F.ceil(F.max(duration)).cast("long"), F.lit(default).cast("long")).alias("target_duration"))


def totals(segments: DataFrame, keys: list[str], index: str, duration: str, size: str) -> DataFrame:
    """Statistics of each stream's segments: number, index range, seconds, bytes, mean, bits a second."""
    return segments.groupBy(*keys).agg(
        F.count("*").alias("segments"), F.min(index).alias("first_index"), F.max(index).alias("last_index"),
        F.round(F.sum(duration), 6).alias("total_duration"), F.sum(size).cast("long").alias("total_bytes"),
        F.round(F.avg(duration), 6).alias("average_duration"),
        F.when(F.sum(duration) > 0, F.floor(F.round(F.sum(size) * 8 / F.sum(duration), 6))).cast("long").alias("bitrate"),
    )


def parts(rows: DataFrame, keys: list[str], segment: str, order: str, retain: int = 3, per_segment: int = 6) -> DataFrame:
    """Partial segments: their place in the segment, whether the segment is among the last `retain`,
    and the hint for the next part."""
    inside = Window.partitionBy(*keys, segment).orderBy(order)
    newest = rows.groupBy(*keys).agg(F.max(segment).alias("_top"))
    r = rows.join(newest, keys).withColumn("part_index", (F.row_number().over(inside) - 1).cast("int"))
    last = F.col("part_index") + 1 >= per_segment
    return r.withColumn("retained", F.col(segment) > F.col("_top") - retain).withColumn("hint_segment", F.col(segment) + F.when(last, 1).otherwise(0)).withColumn(
        "hint_part", F.when(last, 0).otherwise(F.col("part_index") + 1)
    ).drop("_top")


def request_satisfied(msn: Column, part: Column, have_msn: Column, have_part: Column) -> Column:
    """Whether what is available covers a blocking request; no available part number satisfies any part."""
    return (msn < have_msn) | ((msn == have_msn) & (part.isNull() | have_part.isNull() | (part <= have_part)))


def blocking_wait(requests: DataFrame, parts: DataFrame, keys: list[str], at: str, ready: str, position: str, timeout: float) -> DataFrame:
    """For each request the wait until its position is published, or the timeout; 0 if it is there.

    One pass per stream: a request of position p is answered when the first part of position >= p is."""
    first = parts.groupBy(*keys, position).agg(F.min(ready).alias("_ready"))
    w = Window.partitionBy(*keys).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, 0)
    known = first.withColumn("_ready", F.min("_ready").over(w))
    r = requests.join(known, [*keys, position], "left")
    wait = F.greatest(F.lit(0.0), (F.col("_ready") - F.col(at)).cast("double"))
    return r.withColumn(
        "wait", F.when(F.col("_ready").isNull() | (wait > timeout), F.lit(float(timeout))).otherwise(wait)
    ).withColumn("timed_out", F.col("_ready").isNull() | (wait > timeout)).drop("_ready")


def gap_alerts(segments: DataFrame, keys: list[str], index: str, gap: Column, most: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Whether the last `most` segments up to each one are all gaps."""
    s = segments.withColumn("_g", F.coalesce(gap, F.lit(False)).cast("int"))
    out = last_rows(s, keys, index, most, {"_n": lambda w: F.sum("_g").over(w)}, bucket)
    return out.withColumn("alert", F.col("_n") == most).drop("_g", "_n")


def tile_layout(frames: DataFrame, keys: list[str], order: str, duration: str, columns: int, rows: int, bucket: int = BUCKET) -> DataFrame:
    """Thumbnails in row-major sheets: sheet, column, row and start time of each frame; missing durations count 6 s."""
    f = running_sums(frames, keys, order, {"_i": F.lit(1).cast("long"), "start": F.coalesce(F.col(duration), F.lit(6.0))}, bucket)
    return f.select(
        *keys, order, F.floor(F.col("_i") / (columns * rows)).cast("int").alias("sheet"), (F.col("_i") % columns).cast("int").alias("tile_column"),
        (F.floor(F.col("_i") / columns) % rows).cast("int").alias("tile_row"), F.col("start").cast("double").alias("start"),
    )


def join_lines(rows: DataFrame, keys: list[str], order: list[str], line: str, name: str = "text") -> DataFrame:
    """The lines of each key in order, each ended by a line break; null lines are left out."""
    own = F.struct(*order, F.col(line).alias("_line"))
    joined = F.array_sort(F.collect_list(F.when(F.col(line).isNotNull(), own)))
    return rows.groupBy(*keys).agg(F.concat(F.array_join(F.transform(joined, lambda x: x["_line"]), "\n"), F.lit("\n")).alias(name))


def render_live(
    segments: DataFrame, keys: list[str], index: str, duration: str, uri: Column, size: int = 5, version: int = 7,
    playlist_type: str | None = None, ended: bool = False, discontinuity: Column | None = None
) -> DataFrame:
    """(keys, media_sequence, m3u8): the playlist of each stream's last `size` segments."""
    flag = F.coalesce(discontinuity, F.lit(False)) if discontinuity is not None else F.lit(False)
    seq = sequences(segments, keys, index, flag, size)
    kept = last_segments(segments.withColumn("_disc", flag).withColumn("_uri", uri), keys, index, size)
    body = F.concat(
        F.when(F.col("_disc"), "#EXT-X-DISCONTINUITY\n").otherwise(""), F.lit("#EXTINF:"), T.decimal(F.col(duration)), F.lit(",\n"),
        F.col("_uri")
    )
    lines = join_lines(kept.withColumn("_line", body), keys, [index], "_line", "_body")
    target = target_duration(kept, keys, duration)
    out = lines.join(target, keys).join(seq, keys)
    head = F.concat(
        F.lit(f"#EXTM3U\n#EXT-X-VERSION:{version}\n#EXT-X-TARGETDURATION:"), F.col("target_duration").cast("string"),
        F.lit("\n#EXT-X-MEDIA-SEQUENCE:"), F.col("media_sequence").cast("string"),
        F.when(
            F.col("discontinuity_sequence") > 0,
            F.concat(F.lit("\n#EXT-X-DISCONTINUITY-SEQUENCE:"), F.col("discontinuity_sequence").cast("string"))
        ).otherwise(""),
        F.lit("\n" + (f"#EXT-X-PLAYLIST-TYPE:{playlist_type}\n" if playlist_type else "")),
    )
    return out.select(*keys, "media_sequence", F.concat(head, "_body", F.lit("#EXT-X-ENDLIST\n" if ended else "")).alias("m3u8"))
