"""Delivery: bandwidth windows, alerts, grades, adaptation, failover, breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import media as M
from .patterns import BUCKET, last_known, last_rows, ordered_scan, running_sum, trailing


def bandwidth(samples: DataFrame, keys: list[str], micros: Column, size: str, seconds: Column, window: float = 10.0) -> DataFrame:
    """Bits a second over the trailing window of each push: bytes * 8 / seconds; no push lasts under 1 ms."""
    rows = samples.withColumn("_bytes", F.col(size)).withColumn("_secs", F.greatest(seconds, F.lit(0.001)))
    out = trailing(rows, keys, micros, int(window * 1_000_000), {"_b": lambda w: F.sum("_bytes").over(w), "_s": lambda w: F.sum("_secs").over(w)})
    return out.withColumn("bps", F.when(F.col("_s") > 0, F.col("_b") * 8 / F.col("_s")).otherwise(F.lit(0.0))).drop("_bytes", "_secs", "_b", "_s")


def bandwidth_alerts(measured: DataFrame, keys: list[str], order: str, required: Column, preset: str = "standard", bucket: int = BUCKET) -> DataFrame:
    """Rows where the state (normal, insufficient, critical) changes, once enough samples are in, by
    `order` (a whole number); in buckets of row numbers."""
    _, alert, critical, least = M.BANDWIDTH[preset]
    ratio = F.col("bps") / required
    state = F.when(ratio < critical, "critical").when(ratio < alert, "insufficient").otherwise("normal")
    rows = last_rows(measured.withColumn("state", state), keys, order, 2, {"_before": lambda w: F.first("state").over(w)}, bucket, "_n")
    before = F.when(F.col("_n") >= least, F.col("_before")).otherwise("normal")
    return rows.where((F.col("_n") >= least - 1) & (F.col("state") != before)).drop("_n", "_before")


def dashboard(destinations: DataFrame, keys: list[str], grade: str) -> DataFrame:
    """Counts by health and the worst grade."""
    g = F.col(grade)
    return destinations.groupBy(*keys).agg(
        F.count_if(g.isin("excellent", "good")).alias("healthy"), F.count_if(g.isin("fair", "poor")).alias("degraded"),
        F.count_if(g == "critical").alias("failed"),
        F.element_at(F.array(*map(F.lit, M.GRADE_ORDER)), F.coalesce(F.min(M.grade_ordinal(g)), F.lit(0)) + 1).alias("overall"),
    )


def abr_adjustments(recommendations: DataFrame, keys: list[str], order: str, direction: Column, needed: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Rows at which `needed` like recommendations have come in a row since the last adjustment, by
    `order` (a whole number); in buckets of row numbers."""
    r = recommendations.withColumn("direction", direction)
    r = last_rows(r, keys, order, 2, {"_prior": lambda w: F.first("direction").over(w)}, bucket, "_n")
    first = (F.col("_n") == 0) | ~F.col("direction").eqNullSafe(F.col("_prior"))
    r = last_known(r, keys, ["_n"], F.when(first, F.col("_n")), "_start", bucket)
    return r.where((F.col("_n") - F.col("_start") + 1) % needed == 0).drop("_n", "_prior", "_start")


def failover(events: DataFrame, keys: list[str], order: str, failed: Column, recovered: Column, backups: Column, bucket: int = BUCKET) -> DataFrame:
    """The backup in use after each event: none until a failure, one further with each up to the last,
    none again after a recovery. Failures are summed in buckets of `order` (a whole number) and counted
    from the last recovery."""
    one = F.coalesce(failed, F.lit(False)).cast("long")
    r = running_sum(events, keys, order, one, "_f", bucket, inclusive=True)
    r = last_known(r, keys, [order], F.when(recovered, F.col("_f") - one), "_base", bucket)
    n = F.col("_f") - F.coalesce("_base", F.lit(0))
    return r.withColumn("active_backup", F.when(n > 0, F.least(n - 1, backups - 1)).cast("int")).drop("_f", "_base")


def failure_policy(destinations: DataFrame, keys: list[str], failed: Column, primary: Column, policy: str) -> DataFrame:
    """Whether a push as a whole failed: all of them (continue), the primary, or any (require_all)."""
    rule = {"continue": F.bool_and(failed), "primary": F.bool_or(failed & primary), "require_all": F.bool_or(failed)}[policy]
    return destinations.groupBy(*keys).agg(rule.alias("push_failed"))


def breaker_step(state: tuple[int, float | None], at: float, ok: bool, threshold: int, reset: float) -> tuple[tuple[int, float | None], str, bool]:
    """After a call: (state, open or closed or half_open seen by the call, whether it was let through)."""
    failures, opened = state
    if opened is not None and at - opened < reset:
        return state, "open", False
    seen = "closed" if opened is None else "half_open"
    if ok:
        return (0, None), seen, True
    failures += 1
    if opened is None and failures >= threshold:
        opened = at
    return (failures, opened), seen, True


def circuit_breaker(calls: DataFrame, keys: list[str], order: list[str], at: str, ok: str, threshold: int = 5, reset: float = 60.0) -> DataFrame:
    """calls with breaker (the state that each meets) and allowed. Opens after `threshold` failures in a
    row, half opens `reset` later; a failed probe does not renew the time of opening."""
    return ordered_scan(
        calls, keys, order, [at, ok], "breaker string, allowed boolean", lambda: (0, None),
        lambda s, t, good: breaker_step(s, t, good, threshold, reset)
    )


def push_totals(pushes: DataFrame, keys: list[str], order: str, size: str, latency: str, ok: Column) -> DataFrame:
    """Successes, failures, bytes, mean latency and the last success's bytes a second.

    Latencies are added in `order`, so that the mean doesn't depend on how rows are dealt; each stream is sorted, with spill."""
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    good = pushes.withColumn("_ok", ok).withColumn("_run", F.sum(F.when(F.col("_ok"), F.col(latency))).over(along))
    rate = F.when(F.col("_ok") & (F.col(latency) > 0), F.col(size) / F.col(latency))
    return good.groupBy(*keys).agg(
        F.count_if("_ok").alias("successes"), F.count_if(~F.col("_ok")).alias("failures"), F.sum(
            F.when(F.col("_ok"), F.col(size)).otherwise(F.lit(0))
        ).alias("bytes"),
        (F.max_by("_run", order) / F.count(F.when(F.col("_ok"), F.col(latency)))).alias("mean_latency"), F.max_by(rate, F.when(rate.isNotNull(), F.col(order))).alias("last_rate"),
    )


#: Destinations that are broadcast, and parts of the segments that a larger set is sent to.
MAX_DESTINATIONS, FAN_PARTS = 1000, 64


def fan_out(segments: DataFrame, destinations: DataFrame, most: int = MAX_DESTINATIONS) -> DataFrame:
    """Every segment for every destination. Up to `most` destinations are broadcast; a larger set is
    dealt, whole, to each of FAN_PARTS parts of the segments and joined there, with spill."""
    if destinations.limit(most + 1).count() <= most:
        return segments.crossJoin(F.broadcast(destinations))
    own = segments.withColumn("_part", F.expr(f"cast(pmod(xxhash64(struct(*)), {FAN_PARTS}) as int)"))
    every = destinations.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(FAN_PARTS - 1))))
    return own.join(every.hint("merge"), "_part").drop("_part")
