"""Metric, retry, state and calibration streams with their batch twins.

The builders take a batch or a streaming frame; only the calls noted as stream-only differ.
"""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chorale.operators.calibration import merge_moments, CONTEXT, score_statistics
from chorale.operators.evaluate import calibration_alerts
from chorale.operators.fold import fold_sorted
from chorale.operators.skew import attach, scan_over, top_n

# fixed values: metric -> (direction, WARNING, CRITICAL, INFO)
DEFINITIONS = {
    "processing_time_per_minute": ("high", 90.0, 120.0, None), "rtf_ratio": ("high", 1.5, 2.0, None), "memory_usage_peak_mb": ("high", 6144.0, 8192.0, None),
    "cache_hit_rate": ("low", 60.0, None, 80.0), "word_error_rate": ("high", 3.0, 5.0, None), "diarization_error_rate": ("high", 8.0, 15.0, None),
    "entity_accuracy": ("low", 85.0, None, 95.0), "confidence_score_avg": ("low", 0.7, None, 0.9), "error_rate": ("high", 5.0, 10.0, None),
    "timeout_count": ("high", 5.0, 10.0, None), "fallback_activation_rate": ("high", 20.0, 40.0, None), "resource_utilization_cpu": ("high", 80.0, 95.0, None),
    "files_processed_per_hour": ("none", None, None, 10.0), "success_rate": ("low", 90.0, 85.0, None), "user_satisfaction_proxy": ("low", 7.0, None, 8.5),
}


def definitions(spark: SparkSession) -> DataFrame:
    rows = [(n, *d) for n, d in DEFINITIONS.items()]
    return spark.createDataFrame(rows, "name string, direction string, warning double, critical double, info double")


def metric_windows(events: DataFrame, size: str = "300 seconds", step: str = "30 seconds", late: str = "5 minutes") -> DataFrame:
    """Sliding aggregates; values later than ``late`` are dropped by the watermark.  p95 is approximate here and only
    used from 20 values, p99 from 100, the maximum before that; it can be updated before a window closes.  ``metric_windows_final`` waits and is exact."""
    n, v = F.count("*"), F.col("value")
    d = events.withWatermark("ts", late) if events.isStreaming else events
    w = d.groupBy("name", F.window("ts", size, step).alias("w")).agg(
        n.alias("n"), F.avg(v).alias("avg"), F.sum(v).alias("sum"), F.max(v).alias("max"), F.min(v).alias("min"),
        F.when(n >= 20, F.percentile_approx(v, 0.95, 10_000)).otherwise(F.max(v)).alias("p95"), F.when(n >= 100, F.percentile_approx(v, 0.99, 10_000)).otherwise(F.max(v)).alias("p99"))
    return w.select("name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "avg", "sum", "max", "min", "p95", "p99")


def metric_windows_exact(events: DataFrame, size: str, step: str) -> DataFrame:
    """Batch twin with exact quantiles (position p(n+1), linear between neighbours), from value histograms."""
    k = ["name", "start", "end"]
    d = events.select("name", F.window("ts", size, step).alias("w"), "value").select("name", "w.start", "w.end", "value")
    h = d.groupBy(*k, "value").agg(F.count("*").alias("c"))
    m = h.groupBy(*k).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("avg"), F.sum(F.col("c") * F.col("value")).alias("sum"),
                          F.max("value").alias("max"), F.min("value").alias("min"))
    run = scan_over(h, k, ["value"], F.floor(F.col("value") / 1000), upto={"cum": ("sum", F.col("c"))}).join(m.select(*k, "n"), k)

    def at(p: float, name: str):
        pos = (F.col("n") + 1) * p
        lo = F.floor(pos)
        low = F.min(F.when(F.col("cum") >= lo, F.col("value")))
        high = F.min(F.when(F.col("cum") >= lo + 1, F.col("value")))
        frac = F.max(pos - lo)
        return (low + frac * (F.coalesce(high, low) - low)).alias(name)

    q = run.groupBy(*k).agg(at(0.95, "q95"), at(0.99, "q99"))
    return m.join(q, k).select(*k, "n", "avg", "sum", "max", "min", F.when(F.col("n") >= 20, F.col("q95")).otherwise(F.col("max")).alias("p95"),
                               F.when(F.col("n") >= 100, F.col("q99")).otherwise(F.col("max")).alias("p99"))


def metric_windows_final(events: DataFrame, size: str = "300 seconds", step: str = "30 seconds", late: str = "5 minutes") -> DataFrame:
    """Closed sliding windows with exact quantiles, as ``metric_windows_exact`` gives them, for append mode and for batches.

    Two aggregations with state: events are counted by value, which merges over any number of batches, and when the watermark closes a window
    its counts come together.  A window's state is its distinct values.
    """
    d = events.withWatermark("ts", late) if events.isStreaming else events
    h = d.groupBy("name", F.window("ts", size, step).alias("w"), "value").agg(F.count("*").alias("c"))
    c, v = F.col("c"), F.col("value")
    m = h.groupBy("name", "w").agg(F.sum("c").alias("n"), (F.sum(c * v) / F.sum("c")).alias("avg"), F.sum(c * v).alias("sum"), F.max("value").alias("max"), F.min("value").alias("min"),
                                   F.sort_array(F.collect_list(F.struct("value", "c"))).alias("h"))

    def at(p: float) -> Column:
        pos = (F.col("n") + 1) * p
        lo = F.floor(pos)
        none = F.lit(None).cast("double")

        def step_on(acc: Column, x: Column) -> Column:
            cum = acc["cum"] + x["c"]
            return F.struct(cum.alias("cum"), F.coalesce(acc["low"], F.when(cum >= lo, x["value"])).alias("low"), F.coalesce(acc["high"], F.when(cum >= lo + 1, x["value"])).alias("high"))

        found = F.aggregate("h", F.struct(F.lit(0).cast("bigint").alias("cum"), none.alias("low"), none.alias("high")), step_on)
        return found["low"] + (pos - lo) * (F.coalesce(found["high"], found["low"]) - found["low"])

    return m.select("name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "avg", "sum", "max", "min", F.when(F.col("n") >= 20, at(0.95)).otherwise(F.col("max")).alias("p95"),
                    F.when(F.col("n") >= 100, at(0.99)).otherwise(F.col("max")).alias("p99"))


def alerts(events: DataFrame, defs: DataFrame, late: str = "5 minutes") -> DataFrame:
    """One alert per metric, component and second: the first severity whose threshold is crossed.

    ``defs`` is the fixed list of metric definitions.
    """
    d = events.withWatermark("ts", late) if events.isStreaming else events
    j = d.join(defs, "name")
    v, high, low = F.col("value"), F.col("direction") == "high", F.col("direction") == "low"
    over = lambda t: (high & (v > F.col(t))) | (low & (v < F.col(t)))
    severity = F.when(over("warning"), "WARNING").when(over("critical"), "CRITICAL").when(~high & (v > F.col("info")), "INFO")
    second = F.date_trunc("second", "ts")
    a = j.withColumn("severity", severity).where("severity is not null").withColumn("second", second).withColumn(
        "alert_id", F.concat_ws("_", "name", "component", F.unix_timestamp("second").cast("string")))
    a = a.select("alert_id", "ts", "name", "component", "severity", "value", "event_id")
    if events.isStreaming:
        return a.dropDuplicatesWithinWatermark(["alert_id"])
    return a.groupBy("alert_id", "name", "component").agg(F.min_by(F.struct("ts", "severity", "value"), F.struct("ts", "event_id")).alias("a")).select("alert_id", "a.ts", "name", "component", "a.severity", "a.value")


def retry_stream(events: DataFrame, size: str = "1 hour", late: str = "5 minutes") -> DataFrame:
    e = F.col("event")
    n = lambda k: F.count(F.when(e == k, 1))
    d = events.withWatermark("ts", late) if events.isStreaming else events
    return d.groupBy("service", F.window("ts", size).alias("w")).agg(
        F.count("*").alias("attempts"), n("success").alias("success"), n("failure").alias("failure"), n("exhausted").alias("exhausted"), F.max("attempt").alias("max_attempt"),
        F.sum(F.when(e == "success", F.col("duration_ms"))).alias("success_ms")).select("service", F.col("w.start").alias("start"), "attempts", "success", "failure", "exhausted", "max_attempt", "success_ms")


FAILURES, RECOVERY_S, SUCCESSES = 5, 60.0, 2
STATE = "phase string, failures int, successes int, opened double"
CHANGE = "service string, ts timestamp, phase string"


def next_state(state: tuple, events: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """Service phases over ordered call events: five failures in a row open, 60 s later half-open, two successes close."""
    phase, failures, successes, opened = state
    out = []
    for service, ts, event in zip(events["service"], events["ts"], events["event"]):
        now = ts.timestamp()
        before = phase
        if phase == "open" and now - opened >= RECOVERY_S:
            phase, successes = "half_open", 0
            out.append((service, ts, phase))
            before = phase
        if event == "success":
            if phase == "half_open":
                successes += 1
                if successes >= SUCCESSES:
                    phase, failures = "closed", 0
            elif phase == "closed":
                failures = 0
        elif event in ("failure", "exhausted"):
            failures += 1
            if phase == "half_open" or (phase == "closed" and failures >= FAILURES):
                phase, opened = "open", now
        if phase != before:
            out.append((service, ts, phase))
    return (phase, failures, successes, opened), out


FRESH = ("closed", 0, 0, 0.0)
COLUMNS = ["service", "ts", "phase"]


def service_states(events: DataFrame) -> DataFrame:
    """Phase changes per service.  ``events``: service, ts, event_id, event."""
    if events.isStreaming:
        def run(key, batches, state):
            s = tuple(state.get) if state.exists else FRESH
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            s, out = next_state(s, rows)
            state.update(s)
            yield pd.DataFrame(out, columns=COLUMNS)

        return events.select("service", "ts", "event_id", "event").groupBy("service").applyInPandasWithState(run, CHANGE, STATE, "append", "NoTimeout")

    def step(state, pdf):
        s, out = next_state(state or FRESH, pdf)
        return s, pd.DataFrame(out, columns=COLUMNS)

    return fold_sorted(events.select("service", "ts", "event_id", "event"), ["service"], ["ts", "event_id"], CHANGE, step)


# foreachBatch writers: each batch writes the snapshot of its own id from the snapshot before it, so replays agree.

def _latest(spark: SparkSession, path: str, before: int, reader: Callable[[str], DataFrame] | None = None) -> DataFrame | None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    done = [b for b in done if b < before]
    return spark.read.parquet(f"{path}/batch={max(done)}") if done else None


def foreach_batch_registry(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        new = score_statistics(batch)
        old = _latest(batch.sparkSession, path, batch_id)
        merged = new if old is None else merge_moments(old.unionByName(new), [*CONTEXT, "dim"])
        merged.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def foreach_batch_terms(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``merge(base or None, session batch) -> new base`` once per batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        merge(_latest(batch.sparkSession, path, batch_id), batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def foreach_batch_calibration(path: str, last: int = 1000) -> Callable[[DataFrame, int], None]:
    """Keep the last ``last`` events per provider and write the alerts of every batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        old = _latest(batch.sparkSession, f"{path}/events", batch_id)
        both = batch if old is None else old.unionByName(batch)
        kept = top_n(both, ["provider"], [F.desc("ts"), F.desc("doc_id")], last).drop("rank")
        kept.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
        now = batch.sparkSession.read.parquet(f"{path}/events/batch={batch_id}")
        calibration_alerts(now, [F.desc("ts"), F.desc("doc_id")], last).write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")

    return write


def foreach_batch_observers(observers: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """Hand every batch of alerts to each observer; one that fails does not stop the others."""
    def notify(batch: DataFrame, batch_id: int) -> None:
        failed = []
        for o in observers:
            try:
                o(batch, batch_id)
            except Exception as e:  # reported after all observers were called
                failed.append(e)
        if failed:
            raise failed[0]

    return notify
