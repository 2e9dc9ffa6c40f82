"""Frames to segments: live cutting by target duration and keyframes, VOD cutting at sync samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import BUCKET, ordered_scan, running_sum


def segment_start() -> tuple[float, int, int]:
    """(seconds held, frames held, index of the open segment)"""
    return 0.0, 0, 0


def segment_step(
    state: tuple[float, int, int], duration: float | None, may_cut: bool | None, target: float, most: float
) -> tuple[tuple[float, int, int], int]:
    """The next state and the segment of this frame.

    A frame that reaches the target where a cut is allowed opens the next segment; one that reaches
    the maximum closes the open one. The target is tested first. A null duration counts as 0.
    """
    held, n, segment = state
    d = duration or 0.0
    if held + d >= target and may_cut:
        segment += n > 0
        return (d, 1, segment), segment
    if held + d >= most and n > 0:
        return (0.0, 0, segment + 1), segment
    return (held + d, n + 1, segment), segment


def assign_segments(
    frames: DataFrame, keys: list[str], order: list[str], duration: str, keyframe: Column | None, target: float = 6.0,
    most: float | None = None
) -> DataFrame:
    """frames with segment_index: the live segmenter over each stream.

    keyframe: where a cut is allowed; None allows it at any frame (audio, or not aligned). The last
    segment of a stream is what remains when its frames end.
    """
    most = 1.5 * target if most is None else most
    ready = frames.withColumn(
        "_cut", F.lit(True) if keyframe is None else F.coalesce(keyframe, F.lit(False))
    ).withColumn("_d", F.col(duration).cast("double"))
    return ordered_scan(
        ready, keys, order, ["_d", "_cut"], "segment_index int", segment_start, lambda s, d, c: segment_step(s, d, c, target, most)
    ).drop("_cut", "_d")


def build_segments(
    assigned: DataFrame, keys: list[str], order: str, duration: str, keyframe: Column | None = None, codec: Column | None = None
) -> DataFrame:
    """One row per segment: frames, duration, first and last order value, whether it starts with a
    keyframe, and its sorted set of codecs."""
    key = F.lit(True) if keyframe is None else F.coalesce(keyframe, F.lit(False))
    rows = assigned.withColumn("_k", key)
    codecs = [F.array_sort(F.collect_set(codec)).alias("codecs")] if codec is not None else []
    return rows.groupBy(*keys, "segment_index").agg(
        F.count("*").alias("frames"), F.sum(duration).alias("duration"), F.min(order).alias("first_frame"),
        F.max(order).alias("last_frame"), F.min_by("_k", order).alias("independent"), *codecs
    )


def exact_duration(frames: DataFrame, keys: list[str], value: str, timescale: str, order: str) -> DataFrame:
    """Seconds of each group from whole ticks: those of the first frame's timescale, as the segmenter
    that this follows does; frames of another timescale are added only while no later frame matches."""
    first = F.min_by(timescale, order).alias("_ts")
    lead = frames.groupBy(*keys).agg(first)
    rows = frames.join(lead, keys)
    return rows.groupBy(*keys, "_ts").agg(
        (F.sum(F.when(F.col(timescale) == F.col("_ts"), F.col(value)).otherwise(F.lit(0))) / F.col("_ts")).alias("duration")
    ).drop("_ts")


def vod_cuts(samples: DataFrame, keys: list[str], order: str, duration: str, sync: Column, target: float) -> DataFrame:
    """samples from the first sync one on, with segment_index: a new segment at the first sync sample
    at which the open one has lasted `target`."""

    def step(state: tuple[float, int], d: float, is_sync: bool) -> tuple[tuple[float, int], int | None]:
        held, segment = state
        if is_sync and (segment < 0 or held >= target):
            held, segment = 0.0, segment + 1
        return (held + d, segment), (segment if segment >= 0 else None)

    rows = samples.withColumn("_s", F.coalesce(sync, F.lit(False))).withColumn("_d", F.col(duration).cast("double"))
    return ordered_scan(
        rows, keys, [order], ["_d", "_s"], "segment_index int", lambda: (0.0, -1), step
    ).where("segment_index is not null").drop("_s", "_d")


def interleaved(video: DataFrame, audio: DataFrame, keys: list[str], at: str, bucket: int = BUCKET) -> DataFrame:
    """The union of two sets of frames with their place in presentation order, from 1, by `at` (a whole
    number); video first on ties. Places are counted in buckets of time."""
    both = video.withColumn("kind", F.lit("video")).unionByName(audio.withColumn("kind", F.lit("audio")))
    rank = (F.col("kind") == "audio").cast("int")
    counted = running_sum(both.withColumn("_rank", rank), keys, at, F.lit(1).cast("long"), "position", bucket, inclusive=True, ties=("_rank",))
    return counted.drop("_rank")


def align_audio(video: DataFrame, audio: DataFrame, keys: list[str], begin: str, end: str, at: str, index: str, width: float) -> DataFrame:
    """For each video segment the first and last audio sample inside [begin, end) and their number,
    at least 1 when any lies inside; by a bucketed range join."""
    from .patterns import range_join

    inside = range_join(audio.select(*keys, at, index), video, keys, at, begin, end, width)
    return inside.groupBy(*keys, begin, end).agg(F.min(index).alias("first_sample"), F.max(index).alias("last_sample"), F.count("*").alias("samples"))


def vod_files(
    cut: DataFrame, keys: list[str], order: str, ticks: str, payload: str, sync: str, container: str = "fmp4", timescale: int = 90000
) -> DataFrame:
    """(keys, segment_index, content, samples, ticks): the bytes of each segment of vod_cuts(), as fragmented
    MP4 or transport stream (one video track). ticks: a sample's duration on the clock `timescale`.

    A segment starts at the sum of the ticks before it, which is taken over segments, not samples; a
    task holds the samples of one segment.
    """
    from pyspark.sql.window import Window

    from ..sources import transport_stream
    from ..sources.binary import media_segment

    length = cut.groupBy(*keys, "segment_index").agg(F.sum(ticks).alias("_length"))
    before = Window.partitionBy(*keys).orderBy("segment_index").rowsBetween(Window.unboundedPreceding, -1)
    starts = length.withColumn("_start", F.coalesce(F.sum("_length").over(before), F.lit(0))).drop("_length")
    rows = cut.join(starts, [*keys, "segment_index"]).select(
        *keys, "segment_index", "_start", F.col(order).alias("_o"), F.col(ticks).cast("long").alias("_d"),
        F.col(payload).cast("binary").alias("_p"), F.col(sync).cast("boolean").alias("_k")
    )
    kinds = ", ".join(f"`{k}` {cut.schema[k].dataType.simpleString()}" for k in keys)

    def write(table: pa.Table) -> pa.Table:
        own = sorted(table.select(["_o", "_d", "_p", "_k"]).to_pylist(), key=lambda r: r["_o"])
        at, index = table.column("_start")[0].as_py(), table.column("segment_index")[0].as_py()
        if container == "fmp4":
            content = media_segment(index + 1, 1, at, [(r["_d"], 0, r["_k"], r["_p"] or b"") for r in own])
        else:
            frames, t = [], at
            for r in own:
                frames.append((transport_stream.VIDEO, t * 90000 // timescale, None, r["_k"], r["_p"] or b""))
                t += r["_d"]
            content = transport_stream.segment(frames)
        head = [table.column(k).slice(0, 1).combine_chunks() for k in [*keys, "segment_index"]]
        return pa.table(
            [*head, pa.array([content], pa.binary()), pa.array([len(own)], pa.int64()), pa.array([sum(r["_d"] for r in own)], pa.int64())],
            [*keys, "segment_index", "content", "samples", "ticks"]
        )

    return rows.groupBy(*keys, "segment_index").applyInArrow(write, f"{kinds}, segment_index int, content binary, samples long, ticks long")
