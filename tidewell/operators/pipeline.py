"""A live pipeline over rows: counters, monitors, recordings, metadata, renditions, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import media as M
from .ladders import KEY_FORMATS
from .patterns import as_of, running_sum, running_sums


def ticks(segments: DataFrame, keys: list[str], order: str, duration: str, size: str, bucket: int = 1 << 20) -> DataFrame:
    """segments with the pipeline's counters after each: segments, seconds and bytes so far."""
    counters = {"segments_so_far": F.lit(1).cast("long"), "seconds_so_far": F.col(duration), "bytes_so_far": F.col(size)}
    return running_sums(segments, keys, order, counters, bucket, inclusive=True)


def route_quality(events: DataFrame, grade: Column, state: Column, least: str = "fair") -> DataFrame:
    """Events worth telling: failed on a lost connection, degraded under the least grade."""
    low = M.grade_ordinal(grade) < list(M.GRADE_ORDER).index(least)
    kind = F.when(state.isin("disconnected", "failed"), "failed").when(low, "degraded")
    return events.withColumn("event", kind).where("event is not null")


def record(segments: DataFrame, keys: list[str], order: str, duration: str, most: float, bucket: int = 1 << 20) -> DataFrame:
    """Segments that fit a recording of at most `most` seconds: those before which less has been recorded
    and with which no more is."""
    total = running_sum(segments, keys, order, F.col(duration), "_total", bucket, inclusive=True)
    return total.where(F.col("_total") <= F.lit(most)).drop("_total")


def attach_metadata(items: DataFrame, segments: DataFrame, keys: list[str], at: str, index: str, begin: str) -> DataFrame:
    """items with the index of the next segment that begins at or after them: queued metadata goes out with it."""
    back = lambda c: (-F.col(c)).alias("_t")
    left = items.select(*items.columns, back(at))
    right = segments.select(*keys, back(begin).alias("_s"), F.col(index).alias("segment"))
    return as_of(left, right, keys, "_t", "_s", ["segment"]).drop("_t")


def audio_renditions(tracks: DataFrame, keys: list[str], order: str, fallback: bool = True) -> DataFrame:
    """One rendition per track, and its stereo fallback; the first track of each key is the default."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    t = tracks.withColumn("is_default", n == 1)
    if not fallback:
        return t.withColumn("kind", F.lit("spatial"))
    both = t.withColumn("kind", F.explode(F.array(F.lit("spatial"), F.lit("stereo"))))
    return both.withColumn("is_default", F.col("is_default") & (F.col("kind") == "spatial")).withColumn(
        "uri", F.when(F.col("kind") == "stereo", fallback_uri(F.col("uri"))).otherwise(F.col("uri"))
    )


def fallback_uri(uri: Column) -> Column:
    """The stereo twin of a spatial rendition's URI."""
    listed = uri.endswith(".m3u8")
    suffixed = F.when(listed, F.concat(F.replace(uri, F.lit(".m3u8"), F.lit("")), F.lit("_stereo.m3u8"))).otherwise(F.concat(uri, F.lit("_stereo")))
    return F.when(uri.contains("atmos"), F.replace(uri, F.lit("atmos"), F.lit("stereo"))).when(
        uri.contains("spatial"), F.replace(uri, F.lit("spatial"), F.lit("stereo"))
    ).otherwise(suffixed)


def session_keys(systems: DataFrame, system: str, uri: Column) -> DataFrame:
    """A session key for each content protection system: FairPlay by sample, the others by counter mode."""
    formats = F.create_map(*[F.lit(x) for kv in KEY_FORMATS.items() for x in kv])
    return systems.withColumns(
        {
            "method": F.when(F.col(system) == "fairplay", "SAMPLE-AES").otherwise("SAMPLE-AES-CTR"), "uri": uri,
            "key_format": F.element_at(formats, F.col(system)), "key_format_versions": F.lit("1")
        }
    )


def random_key() -> Column:
    """16 random bytes: a UUID's digits, hashed, so that its fixed ones don't show."""
    return F.substr(F.unhex(F.sha2(F.concat(F.uuid(), F.uuid()).cast("binary"), 256)), F.lit(1), F.lit(16))


def describe_policy(kind: Column, n: Column) -> Column:
    """A rotation policy in words."""
    num = n.cast("long").cast("string")
    return F.when(kind == "everySegment", "Rotate every segment").when(kind == "interval", F.concat(F.lit("Rotate every "), num, F.lit(" seconds"))).when(
        kind == "everyNSegments", F.concat(F.lit("Rotate every "), num, F.lit(" segments"))
    ).when(kind == "manual", "Manual rotation").otherwise("No rotation")


def rotates(kind: Column, n: Column, segment: Column, elapsed: Column, last: Column) -> Column:
    """Whether a segment takes a new key under its policy."""
    return F.when(kind == "everySegment", True).when(kind == "interval", elapsed >= n).when(
        kind == "everyNSegments", segment - last >= n
    ).otherwise(False)


def captions_and_more(captions: DataFrame, subtitles: DataFrame, descriptions: DataFrame) -> DataFrame:
    """All accessibility renditions of a configuration, told apart by `source`."""
    return captions.withColumn("source", F.lit("captions")).unionByName(subtitles.withColumn("source", F.lit("subtitles")), allowMissingColumns=True).unionByName(
        descriptions.withColumn("source", F.lit("description")), allowMissingColumns=True
    )


def poll_progress(job: Column, fraction: Column) -> Column:
    """Overall progress of a remote job: 0.30 before it starts, 0.80 when it is done."""
    return F.when(job == "completed", F.lit(0.8)).otherwise(0.30 + 0.50 * fraction)


def run_summary(events: DataFrame, keys: list[str], at: str, size: str, reason: str) -> DataFrame:
    """Seconds, segments, bytes and the last reason of each run."""
    return events.groupBy(*keys).agg(
        (F.max(at) - F.min(at)).alias("seconds"), F.count("*").alias("segments"), F.sum(size).alias("bytes"),
        F.max_by(reason, at).alias("reason")
    )


def speed_factor(source: Column, spent: Column) -> Column:
    return F.when(spent > 0, source / spent).otherwise(0.0)


def presets(spark: SparkSession) -> DataFrame:
    """The quality presets as a table."""
    return spark.createDataFrame(M.QUALITY, "name string, width int, height int, video_rate long, audio_rate long")


def ladder_masters(rungs: DataFrame, key: str) -> DataFrame:
    """(key, text): the master playlist of each ladder (rows of presets()), by total bandwidth."""
    from ..sources import sinks

    none = F.lit(None).cast("string")
    total = F.col("video_rate") + F.col("audio_rate")
    place = F.row_number().over(Window.partitionBy(key).orderBy(total, "name")) - 1
    v = rungs.select(
        key, place.alias("pos"), F.concat("name", F.lit("/playlist.m3u8")).alias("uri"), total.alias("bandwidth"),
        F.lit(None).cast("long").alias("average_bandwidth"), F.struct("width", "height").alias("resolution"),
        F.lit(None).cast("double").alias("frame_rate"), *[
            none.alias(c)
            for c in ("codecs", "supplemental_codecs", "audio", "video", "subtitles", "closed_captions", "hdcp_level", "video_range", "video_layout")
        ],
    )
    flags = ("is_default", "autoselect", "forced")
    texts = ("type", "group_id", "name", "language", "assoc_language", "uri", "instream_id", "channels", "characteristics")
    m = rungs.select(key).limit(0).select(key, F.lit(0).alias("pos"), *[none.alias(c) for c in texts], *[F.lit(False).alias(c) for c in flags])
    heads = rungs.select(key).distinct().select(key, F.lit(7).alias("version"), F.lit(True).alias("independent_segments"))
    return sinks.master_playlist(heads, m, v, key)
