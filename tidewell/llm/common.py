"""Shared pieces: shared-folder tables, connected components, table loading."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import discard, mark, materialize, release, settle, shared_dir  # noqa: F401

#: Links up to whose number their minima are broadcast; a minimum is two numbers.
MAX_BROADCAST = 200_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name_or_path: str) -> str:
    """A tokenizer file: a path, or a name that the public_tokenizers package knows."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(a, b) links between bigint nodes -> (node, component), component = smallest node reachable.

    Alternating large-star and small-star steps.  Each takes a minimum for a node (partial
    aggregation, so a hub of any degree costs one row per task) and a join back, with minima that are
    broadcast up to MAX_BROADCAST links, and beyond that in a join that adaptive execution may split;
    nothing is gathered by node or on the driver except a checksum.
    Nodes without links don't appear.  Null ends and loops are ignored.
    """
    e = (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    since = mark()
    e = materialize(e, label)
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        sized = F.broadcast if state["n"] <= MAX_BROADCAST else (lambda minima: minima)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.where("b > a")
            .join(sized(least), "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        e = (
            large.join(sized(small), "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .distinct()
        )
        e = materialize(e, label)
        discard(e.sparkSession, since)
    # every edge is now (node, smallest node)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def slices(batch: pa.RecordBatch, column: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in `column` have about `limit` bytes together, or one row beyond it:
    what a worker makes of a part is bounded however much larger than the text it is."""
    held = first = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            held, first = 0, i
        held += n
    yield batch.slice(first)
