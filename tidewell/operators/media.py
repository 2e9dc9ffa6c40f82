"""Sample tables of tracks: run lengths to samples, times, sizes, places in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .patterns import BUCKET, last_known, running_sums


def decode_times(runs: DataFrame, keys: list[str], order: str, count: str, delta: str, bucket: int = BUCKET) -> DataFrame:
    """(keys, sample, dts, delta): one row per sample of the run-length table, samples from 0.

    Prefix sums of the runs, in buckets of `order`, place each run; samples inside a run need none.
    """
    length = F.greatest(F.col(count), F.lit(0)).cast("long")
    r = running_sums(runs, keys, order, {"_n": length, "_t": length * F.col(delta)}, bucket).where(F.col(count) > 0)
    s = r.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)))
    return s.select(
        *keys, (F.col("_n") + F.col("_i")).cast("long").alias("sample"),
        (F.col("_t") + F.col("_i") * F.col(delta)).cast("long").alias("dts"), F.col(delta).cast("long").alias("delta")
    )


def chunk_runs(stsc: DataFrame, keys: list[str], first: str, per: str, chunks: Column) -> DataFrame:
    """Expands (first chunk, samples per chunk) to (keys, chunk, samples), chunks from 1 up to `chunks`."""
    nxt = F.coalesce(F.lead(first).over(Window.partitionBy(*keys).orderBy(first)) - 1, chunks)
    r = stsc.withColumn("_last", nxt).where(F.col("_last") >= F.col(first))
    return r.withColumn(
        "chunk", F.explode(F.sequence(F.col(first).cast("long"), F.col("_last").cast("long")))
    ).select(*keys, "chunk", F.col(per).cast("long").alias("samples"))


def sample_offsets(samples: DataFrame, keys: list[str], sample: str, size: str, chunk: str, offset: str) -> DataFrame:
    """samples (each with its chunk and the chunk's offset) with file_offset: the chunk's plus earlier sizes in it."""
    w = Window.partitionBy(*keys, chunk).orderBy(sample).rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("file_offset", F.col(offset) + F.coalesce(F.sum(size).over(w), F.lit(0)))


def nearest_sync(samples: DataFrame, keys: list[str], sample: str, sync: Column, bucket: int = BUCKET) -> DataFrame:
    """samples with nearest_sync: the last sync sample up to each, else the first of all; without any, the sample itself."""
    own = F.when(F.coalesce(sync, F.lit(False)), F.col(sample))
    first = samples.groupBy(*keys).agg(F.min(own).alias("_first"))
    known = last_known(samples, keys, [sample], own, "_last", bucket)
    return known.join(first, keys).withColumn("nearest_sync", F.coalesce("_last", "_first", F.col(sample))).drop("_last", "_first")


def presentation_times(
    samples: DataFrame, offsets: DataFrame, keys: list[str], sample: str, dts: str, order: str, count: str, offset: str
) -> DataFrame:
    """samples with pts: dts plus the run-length offset that covers the sample, none beyond the table."""
    from .patterns import range_join

    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = offsets.withColumn(
        "_lo", F.coalesce(F.sum(count).over(before), F.lit(0)).cast("long")
    ).withColumn("_hi", F.col("_lo") + F.col(count)).select(*keys, "_lo", "_hi", F.col(offset).alias("_off"))
    hit = range_join(samples, runs, keys, sample, "_lo", "_hi", 4096).select(*keys, sample, "_off")
    return samples.join(hit, [*keys, sample], "left").withColumn("pts", F.col(dts) + F.coalesce("_off", F.lit(0))).drop("_off")
