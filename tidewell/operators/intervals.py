"""Date ranges, chapters, keys: intervals that open, close, merge and rotate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .patterns import ordered_scan


def lifecycle(events: DataFrame, keys: list[str], order: str, kind: Column, at: Column) -> DataFrame:
    """The state of each interval after its events: start of the last opening, end of the last closing
    after it, and open, closed or expired. Events other than opening on an unknown interval count for nothing."""
    e = events.select(*keys, F.col(order).alias("_o"), kind.alias("_k"), at.alias("_at"))
    opened = e.where("_k = 'open'").groupBy(*keys).agg(F.min("_o").alias("_first"), F.max("_o").alias("_last"), F.max_by("_at", "_o").alias("start"))
    j = e.join(opened, keys)
    closed = (F.col("_k") == "close") & (F.col("_o") > F.col("_last"))
    expired = (F.col("_k") == "expire") & (F.col("_o") > F.col("_last"))
    s = j.groupBy(*keys, "start").agg(
        F.max_by(F.when(closed, F.col("_at")), F.when(closed, F.col("_o"))).alias("end"), F.bool_or(closed).alias("_c"),
        F.max(F.when(closed, F.col("_o"))).alias("_co"), F.max(F.when(expired, F.col("_o"))).alias("_eo"),
        F.count_if((F.col("_k") == "update") & (F.col("_o") > F.col("_first"))).alias("updates")
    )
    state = F.when(F.col("_c") & (F.col("_eo") > F.col("_co")), "expired").when(F.col("_c"), "closed").otherwise("open")
    return s.select(*keys, "start", "end", state.alias("state"), "updates")


def chapter_ends(chapters: DataFrame, keys: list[str], start: str, end: Column, total: Column) -> DataFrame:
    """chapters with chapter_end: the explicit one, else the next start, else the total."""
    w = Window.partitionBy(*keys).orderBy(start)
    return chapters.withColumn("chapter_end", F.coalesce(end, F.lead(start).over(w), total))


def merge_short(chapters: DataFrame, keys: list[str], start: str, end: str, least: float = 10.0) -> DataFrame:
    """(keys, chapter, start, end): a short chapter is absorbed by the one before, and a short one kept
    so far grows by the next; the first always stays."""

    def step(state: tuple | None, a: float, b: float) -> tuple[tuple, int]:
        if not state:
            return (0, a, b), 0
        n, first, last = state
        if last - first < least or b - a < least:
            return (n, first, b), n
        return (n + 1, a, b), n + 1

    marked = ordered_scan(chapters, keys, [start], [start, end], "chapter int", tuple, step)
    return marked.groupBy(*keys, "chapter").agg(
        F.min(start).alias("start"), F.max_by(end, start).alias("end"),
        F.min_by(F.struct(*[c for c in chapters.columns if c not in keys]), start).alias("first")
    )


def epochs_every(segments: DataFrame, index: Column, every: int, first: int | Column = 0) -> DataFrame:
    """segments with key_epoch: a new key every `every` segments from the first."""
    return segments.withColumn("key_epoch", F.floor((index - first) / every).cast("int"))


def epochs_elapsed(segments: DataFrame, keys: list[str], order: str, at: str, seconds: float) -> DataFrame:
    """segments with key_epoch: the first takes a key, and each that comes `seconds` after the last rotation."""

    def step(state: tuple | None, t: float) -> tuple[tuple, int]:
        if not state:
            return (t, 0), 0
        last, n = state
        return ((t, n + 1), n + 1) if t - last >= seconds else (state, n)

    return ordered_scan(segments, keys, [order], [at], "key_epoch int", tuple, step)


def in_range(ranges: DataFrame, start: str, low: Column, high: Column) -> DataFrame:
    """Ranges that start between two dates, both included; null starts don't."""
    return ranges.where(F.col(start).between(low, high))


def upcoming(ranges: DataFrame, done: DataFrame, key: str, start: str, now: Column) -> DataFrame:
    """Ranges not completed that start at or after `now`."""
    return ranges.where(F.col(start) >= now).join(done.select(key).distinct(), key, "left_anti")
