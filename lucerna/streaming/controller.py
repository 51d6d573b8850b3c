"""Navigation completions as streams: windows, capacity, cooldown, at-most-once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Control:
    start: int = 16
    maximum: int = 40
    growth: int = 2
    healthy: int = 2
    completions: int = 20
    window_ms: int = 10_000
    error_rate: float = 0.15
    timeout_rate: float = 0.1
    baseline_p95: float = 500.0
    p95_factor: float = 2.0


def health(events: DataFrame, minutes: int = 10) -> DataFrame:
    """Error and time-out rates and nearest-rank 95th percentile of each tumbling window of (ts, duration, failed, timed_out); works on streams and tables alike."""
    n = F.count("*")
    late = F.coalesce(F.sum(F.col("timed_out").cast("int")), F.lit(0)) if "timed_out" in events.columns else F.lit(0)
    return events.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(
        n.alias("n"), F.sum(F.col("failed").cast("int")).alias("errors"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration)").alias("p95"), late.alias("late")
    ).select(F.col("w.start").alias("window_start"), "n", "errors", (F.col("errors") / F.col("n")).alias("error_rate"), (F.col("late") / F.col("n")).alias("timeout_rate"), "p95")


def fold(rows: pd.DataFrame, state: tuple, control: Control) -> tuple[list[tuple], tuple]:
    """Closes count-and-time windows over completions in time order.

    A window closes at the first completion that finds enough of them and enough
    time gone.  Unhealthy windows halve the capacity; enough healthy ones in a
    row raise it.  State: (window's start, durations, failures, time-outs, healthy windows, capacity).
    """
    began, durations, failed, late, healthy, capacity = state
    durations, out = list(durations), []
    for ts, duration, bad, slow in zip(rows["ms"], rows["duration"], rows["failed"], rows["timed_out"]):
        began = ts if began is None else began
        durations.append(float(duration))
        failed, late, n = failed + bool(bad), late + bool(slow), len(durations)
        if n < control.completions or ts - began < control.window_ms:
            continue
        p95 = sorted(durations)[max(0, math.ceil(0.95 * n) - 1)]
        sick = failed / n > control.error_rate or late / n > control.timeout_rate or p95 > control.p95_factor * control.baseline_p95
        capacity = max(1, math.ceil(capacity / 2)) if sick else capacity
        healthy = 0 if sick else healthy + 1
        if healthy >= control.healthy:
            capacity, healthy = min(capacity + control.growth, control.maximum), 0
        out.append((ts, n, failed / n, p95, sick, capacity))
        began, durations, failed, late = ts, [], 0, 0
    return out, (began, durations, failed, late, healthy, capacity)


_OUT = "controller string, closed_ms long, n int, error_rate double, p95 double, unhealthy boolean, capacity int"
_NAMES = ["closed_ms", "n", "error_rate", "p95", "unhealthy", "capacity"]


def _fresh(control: Control) -> tuple:
    return None, [], 0, 0, 0, control.start


def capacity_batch(events: DataFrame, control: Control = Control()) -> DataFrame:
    """The controller over a table (controller, ms, duration, failed, timed_out): one fold per controller."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        closed, _ = fold(rows.sort_values(["ms", "duration"]), _fresh(control), control)
        out = pd.DataFrame(closed, columns=_NAMES)
        out.insert(0, "controller", rows["controller"].iloc[0])
        return out

    return events.groupBy("controller").applyInPandas(run, _OUT)


def capacity_stream(events: DataFrame, control: Control = Control()) -> DataFrame:
    """The same over a stream: the open window, the streak and the capacity are state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _fresh(control)
        if state.exists:
            began, durations, failed, late, healthy, capacity = state.get
            held = (None if began < 0 else began, list(durations), failed, late, healthy, capacity)
        rows = pd.concat(list(batches))
        closed, held = fold(rows.sort_values(["ms", "duration"]), held, control)
        state.update((-1 if held[0] is None else int(held[0]), held[1], *map(int, held[2:])))
        out = pd.DataFrame(closed, columns=_NAMES)
        out.insert(0, "controller", key[0])
        yield out

    kept = "began long, durations array<double>, failed int, late int, healthy int, capacity int"
    return events.groupBy("controller").applyInPandasWithState(run, _OUT, kept, "append", GroupStateTimeout.NoTimeout)


def emit_once(events: DataFrame, keys: list[str]) -> DataFrame:
    """At most one row per key over the whole stream; the state never expires, as the promise has no end."""
    return events.dropDuplicates(keys)


def emit_into(events: DataFrame, consumed_path: str, keys: list[str], sink) -> object:
    """At most once against a stored table: a micro-batch reserves what nobody has consumed, then emits it.

    The keys are recorded before the sink sees a row, so a batch that fails in
    between, and is tried again, finds them taken and emits nothing twice.
    """

    def once(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(consumed_path)
        fresh = batch.dropDuplicates(keys)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(consumed_path).select(*keys), keys, "left_anti")
        # what is reserved and what is emitted are the same rows, whatever is read again
        fresh = fresh.persist()
        try:
            fresh.select(*keys).write.mode("append").parquet(consumed_path)
            sink(fresh, number)
        finally:
            fresh.unpersist()

    return events.writeStream.foreachBatch(once)
