"""Ordered patterns that the operators share.

Streams are partitioned by their key.  What needs only sums or a bounded past is cut into buckets of
the order column first, so that one very long stream spreads over tasks; what depends on its own
result row by row is scanned in order by a worker that holds one state, not the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

BUCKET = 1 << 20


def ordered_scan(
    df: DataFrame, keys: list[str], order: list[str], inputs: list[str], output: str, start: Callable[[], object],
    step: Callable[..., tuple]
) -> DataFrame:
    """df with the columns of `output` (a DDL) added: step(state, *inputs) -> (state, *outputs) along
    each key's rows in order. Rows stream through the worker; only the state is held."""
    added = StructType.fromDDL(output)
    types = [to_arrow_type(f.dataType) for f in added]
    schema = StructType([*df.schema.fields, *added.fields])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            ids = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)
            out = []
            for key, row in zip(ids, values, strict=True):
                if state is None or key != now:
                    now, state = key, start()
                state, *made = step(state, *row)
                out.append(made)
            columns = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, bucket: int = BUCKET, inclusive: bool = False, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Sum of `value` over a key's earlier rows by `order` (a whole-number column) and then `ties`; rows
    alike in both come in no order."""
    return running_sums(df, keys, order, {name: value}, bucket, inclusive, ties)


def running_sums(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], bucket: int = BUCKET, inclusive: bool = False, ties: tuple[str, ...] = ()
) -> DataFrame:
    """running_sum() of several values in one pass.

    Rows are summed inside buckets of the order column; the buckets' totals, few to a key, are summed
    across, and the two parts added.
    """
    b = df.withColumns({f"_v_{n}": v for n, v in values.items()}).withColumn("_b", F.floor(F.col(order) / bucket).cast("long"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    totals = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_before_{n}") for n in values])
    b = b.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values}).join(totals, [*keys, "_b"])
    return b.withColumns({n: F.col(f"_before_{n}") + F.col(f"_in_{n}") for n in values}).select(*df.columns, *values)


def last_rows(
    df: DataFrame, keys: list[str], order: str, size: int, aggregates: dict[str, Callable[[object], Column]], bucket: int = BUCKET,
    ordinal: str | None = None
) -> DataFrame:
    """Aggregates over each row and the `size` - 1 before it, by a row number made of running sums, so that
    the rows of one key spread over buckets of row numbers. `ordinal` names that number, from 0, if it is kept."""
    name = ordinal or "_ordinal_"
    numbered = running_sum(df, keys, order, F.lit(1).cast("long"), name, bucket)
    out = trailing(numbered, keys, F.col(name), size - 1, aggregates, 1 << 16)
    return out if ordinal else out.drop(name)


def last_known(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, bucket: float = BUCKET) -> DataFrame:
    """The last non-null `value` of a key up to and with each row, by `order` (its first column a number).

    Taken inside buckets of the first order column; each bucket then falls back on the last value of
    the buckets before it, of which there are few to a key."""
    b = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order[0]) / bucket).cast("long"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("_v").isNotNull(), F.struct(*order))
    ends = b.groupBy(*keys, "_b").agg(F.max_by("_v", known).alias("_end")).withColumn(
        "_before", F.last("_end", ignorenulls=True).over(across)
    ).drop("_end")
    return b.withColumn(
        "_in", F.last("_v", ignorenulls=True).over(inside)
    ).join(ends, [*keys, "_b"]).withColumn(name, F.coalesce("_in", "_before")).select(*df.columns, name)


def trailing(
    df: DataFrame, keys: list[str], order: Column, width: int, aggregates: dict[str, Callable[[object], Column]], span: int | None = None
) -> DataFrame:
    """Aggregates over the rows of a key within `width` (in units of the whole-number `order`) before
    each row, itself and ties included. Buckets of `span` (eight widths), each with a copy of the rows
    just before it, bound a task by time instead of by key."""
    span = max(span or 8 * width, width, 1)
    b = df.withColumn("_order_", order).withColumn("_home_", F.floor(F.col("_order_") / span).cast("long"))
    b = b.withColumn(
        "_bucket_",
        F.explode(
            F.when((F.col("_home_") + 1) * span - F.col("_order_") <= width, F.array("_home_", F.col("_home_") + 1)).otherwise(F.array("_home_"))
        )
    )
    w = Window.partitionBy(*keys, "_bucket_").orderBy("_order_").rangeBetween(-width, 0)
    for name, make in aggregates.items():
        b = b.withColumn(name, make(w))
    return b.where("_bucket_ = _home_").drop("_order_", "_home_", "_bucket_")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, take: list[str], bucket: float = BUCKET) -> DataFrame:
    """left with the columns `take` of right's last row of the key whose `right_at` <= `at`, null if none.

    One sorted pass over the union, by buckets of the time; ties take the right row.
    """
    kind = StructType([right.schema[c] for c in take])
    both = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(kind).alias("_r")).unionByName(
        right.select(
            *keys, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema).alias("_l"),
            F.struct(*take).alias("_r")
        )
    )
    found = last_known(both, keys, ["_t", "_side"], F.col("_r"), "_f", bucket).where("_side = 1")
    return found.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], *[F.col(f"_f.{c}").alias(c) for c in take])


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, begin: str, end: str, width: float) -> DataFrame:
    """points joined to spans with begin <= at < end, by buckets of `width` so that it is a hash join."""
    p = points.withColumn("_b", F.floor(F.col(at) / width).cast("long"))
    last = F.greatest(F.floor(F.col(begin) / width), F.ceil(F.col(end) / width) - 1).cast("long")
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(begin) / width).cast("long"), last)))
    return p.join(s, [*keys, "_b"]).where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_b")


def islands(df: DataFrame, keys: list[str], order: str, inside: Column, name: str = "run", bucket: int = BUCKET) -> DataFrame:
    """Rows where `inside` holds, with a number for each run of consecutive `order` values."""
    counted = running_sum(df.where(inside), keys, order, F.lit(1).cast("long"), "_place_", bucket, inclusive=True)
    return counted.withColumn(name, F.col(order) - F.col("_place_")).drop("_place_")
