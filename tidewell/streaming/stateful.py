"""Streaming forms of the ordered operators: the same steps, with the state kept by Spark per key.

Rows of a micro-batch are taken in the order given; a key's batches must come in order, as a log or a
partitioned queue delivers them.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import media as M
from ..operators.segmenter import segment_start, segment_step
from ..operators.transport import breaker_step


def stateful(
    stream: DataFrame, keys: list[str], order: list[str], output: str, start: Callable[[], object],
    step: Callable[[object, dict], tuple[object, list[tuple]]]
) -> DataFrame:
    """(keys, *output) of step(state, row) -> (state, output rows) along each key's rows.

    The state is what `step` makes of it and no more; keep it of bounded size."""
    names = [x.strip().split(" ")[0].strip("`") for x in output.split(",")]
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else start()
        rows = pd.concat(list(batches)).sort_values(order)
        out: list[tuple] = []
        for row in rows.to_dict("records"):
            now, made = step(now, row)
            out += [(*key, *m) for m in made]
        state.update((pickle.dumps(now),))
        yield pd.DataFrame(out, columns=[*keys, *names])

    return stream.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, {output}", "state binary", "append", GroupStateTimeout.NoTimeout)


def live_segments(
    stream: DataFrame, keys: list[str], order: str, duration: str, keyframe: Column | None, target: float = 6.0, most: float | None = None,
    end: Column | None = None
) -> DataFrame:
    """Segments as they close: (keys, segment_index, frames, duration, first_frame, last_frame, independent).

    A row for which `end` holds is no frame: it closes the open segment of its key, as a forced boundary
    or the final flush; without an open one it does nothing. A frame older than the last one of its key
    is rejected."""
    most = 1.5 * target if most is None else most
    rows = stream.withColumn(
        "_cut", F.lit(True) if keyframe is None else F.coalesce(keyframe, F.lit(False))
    ).withColumn("_end", F.lit(False) if end is None else F.coalesce(end, F.lit(False)))

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        inner, open_, newest = state
        out = []
        if row["_end"]:
            return (((0.0, 0, open_[0] + 1), None, newest), [open_]) if open_ else (state, [])
        if newest is not None and row[order] < newest:
            return state, []
        d = float(row[duration] or 0.0)
        inner, segment = segment_step(inner, d, bool(row["_cut"]), target, most)
        if open_ and open_[0] != segment:
            out.append(open_)
            open_ = None
        if open_:
            open_ = (segment, open_[1] + 1, open_[2] + d, open_[3], row[order], open_[5])
        else:
            open_ = (segment, 1, d, row[order], row[order], bool(row["_cut"]))
        if inner[1] == 0:  # the maximum closed it
            out.append(open_)
            open_ = None
        return (inner, open_, row[order]), out

    kind = stream.schema[order].dataType.simpleString()
    return stateful(
        rows, keys, [order],
        f"segment_index int, frames long, duration double, first_frame {kind}, last_frame {kind}, independent boolean",
        lambda: (segment_start(), None, None), step
    )


def playlist_states(stream: DataFrame, keys: list[str], index: str, duration: str, discontinuity: Column, size: int = 5) -> DataFrame:
    """After each segment: first and last index, MEDIA-SEQUENCE, DISCONTINUITY-SEQUENCE, target."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        kept, gone, marks = state
        kept = [*kept, (row[index], float(row[duration]), bool(row["_disc"]))]
        while len(kept) > size:
            marks += kept[0][2]
            gone += 1
            kept = kept[1:]
        return (kept, gone, marks), [(kept[0][0], kept[-1][0], gone, marks, int(-(-max(k[1] for k in kept) // 1)))]

    kind = stream.schema[index].dataType.simpleString()
    rows = stream.withColumn("_disc", F.coalesce(discontinuity, F.lit(False)))
    return stateful(
        rows, keys, [index],
        f"first_index {kind}, last_index {kind}, media_sequence long, discontinuity_sequence long, target_duration long",
        lambda: ([], 0, 0), step
    )


def bandwidth_alerts(
    stream: DataFrame, keys: list[str], order: str, at: str, size: str, seconds: str, required: float, preset: str = "standard"
) -> DataFrame:
    """Changes of the bandwidth state over the trailing window of the preset, in event time."""
    window, alert, critical, least = M.BANDWIDTH[preset]

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        samples, seen, before = state
        now = float(row[at])
        samples = [s for s in samples if s[0] >= now - window] + [(now, int(row[size]), max(0.001, float(row[seconds])))]
        bps = sum(s[1] for s in samples) * 8 / sum(s[2] for s in samples)
        ratio = bps / required
        state_now = "critical" if ratio < critical else "insufficient" if ratio < alert else "normal"
        seen += 1
        if seen >= least and state_now != before:
            return (samples, seen, state_now), [(row[order], state_now, bps)]
        return (samples, seen, before), []

    kind = stream.schema[order].dataType.simpleString()
    return stateful(stream, keys, [order], f"{order} {kind}, state string, bps double", lambda: ([], 0, "normal"), step)


def circuit_breaker(stream: DataFrame, keys: list[str], order: str, at: str, ok: str, threshold: int = 5, reset: float = 60.0) -> DataFrame:
    """(keys, order, breaker, allowed) of each call."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        state, seen, allowed = breaker_step(state, float(row[at]), bool(row[ok]), threshold, reset)
        return state, [(row[order], seen, allowed)]

    kind = stream.schema[order].dataType.simpleString()
    return stateful(stream, keys, [order], f"{order} {kind}, breaker string, allowed boolean", lambda: (0, None), step)


def key_epochs(stream: DataFrame, keys: list[str], order: str, at: str, seconds: float) -> DataFrame:
    """(keys, order, key_epoch): a new key once `seconds` have passed since the last."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        last, n = state
        now = float(row[at])
        if last is None or now - last >= seconds:
            last, n = now, n + 1
        return (last, n), [(row[order], n)]

    kind = stream.schema[order].dataType.simpleString()
    return stateful(stream, keys, [order], f"{order} {kind}, key_epoch int", lambda: (None, -1), step)


def framed(stream: DataFrame, keys: list[str], order: str, content: str) -> DataFrame:
    """ADTS frames of byte chunks: what a chunk leaves over is put before the next of its key."""
    from ..sources.binary import adts_frames

    def step(rest: bytes, row: dict) -> tuple[bytes, list[tuple]]:
        data = rest + bytes(row[content] or b"")
        found = adts_frames(data)
        used = found[-1][0] + found[-1][1] if found else 0
        # without a frame, only what may begin one is worth keeping
        left = data[used:] if found or len(data) < 8192 else data[-8191:]
        return left, [(row[order], length, rate) for _, length, _, _, rate, _ in found]

    kind = stream.schema[order].dataType.simpleString()
    return stateful(stream, keys, [order], f"{order} {kind}, length int, sample_rate int", bytes, step)


def windowed_bandwidth(
    stream: DataFrame, keys: list[str], ts: str, size: Column, seconds: Column, window: str = "10 seconds", late: str = "30 seconds"
) -> DataFrame:
    """Bits a second by event-time window and key, late rows accepted up to the watermark; built-in state."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *keys)
    return w.agg(F.sum(size).alias("bytes"), F.sum(F.greatest(seconds, F.lit(0.001))).alias("seconds")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "bytes", (F.col("bytes") * 8 / F.col("seconds")).alias("bps")
    )


def drained(rows: DataFrame, make: Callable[[DataFrame], DataFrame], label: str, batches: int = 1) -> DataFrame:
    """What a streaming operator gives for rows that are there already: they are written to the shared
    folder, `batches` files one after the other along their first column (a number), each a micro-batch;
    run through `make` until the input is used up; and the output table is read back."""
    from ..stage import adopt, shared_dir

    spark, at = rows.sparkSession, F.col(rows.columns[0])
    top = f"{shared_dir(spark).rstrip('/')}/tidewell-{uuid.uuid4().hex}-{label}"
    adopt(spark, top)
    cuts = rows.approxQuantile(rows.columns[0], [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = rows if low is None else rows.where(at > low)
        (part if high is None else part.where(at <= high)).coalesce(1).write.parquet(f"{top}/in/{i}")
    read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{top}/in")
    stream = make(read)
    writer = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")
