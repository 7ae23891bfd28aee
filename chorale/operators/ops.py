"""Operations: costs, service reliability, stage budgets, manifests, run comparison, inventories and lineage."""
from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from chorale.operators.skew import attach, scan_over
from chorale.session import cut_lineage


def cost_summary(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost, calls, duration and tokens by service and model with totals (``*``); ``prices`` is the fixed price list."""
    d = calls.join(prices, "model", "left")
    cost = F.coalesce(F.col("audio_seconds") / 60 * F.col("per_minute"), F.lit(0.0)) \
        + F.coalesce(F.col("input_tokens") / 1000 * F.col("per_1k_input") + F.col("output_tokens") / 1000 * F.col("per_1k_output"), F.lit(0.0))
    m = d.withColumn("cost", cost).rollup("service", "model").agg(
        F.count("*").alias("calls"), F.sum("cost").alias("cost"), F.sum("duration").alias("duration"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return m.select(F.coalesce("service", F.lit("*")).alias("service"), F.coalesce("model", F.lit("*")).alias("model"), "calls", "cost", "duration", "tokens",
                    (F.col("cost") / F.col("calls")).alias("cost_per_call"))


def service_reliability(events: DataFrame) -> DataFrame:
    """Attempts, outcomes, trips, retry time and the reliability score per service.  ``events``: service, event, attempt, duration_ms."""
    e = F.col("event")
    n = lambda c: F.count(F.when(c, 1))
    d = events.groupBy("service").agg(
        F.count("*").alias("attempts"), n(e == "success").alias("success"), n(e == "failure").alias("failure"), n(e == "exhausted").alias("trips"),
        F.sum(F.when(e == "attempt", F.col("duration_ms")).otherwise(0.0)).alias("retry_ms"), F.max("attempt").alias("max_attempt"),
        F.avg(F.when(e == "success", F.col("duration_ms"))).alias("success_mean_ms"))
    rate = F.col("success") / F.col("attempts")
    retries = (F.col("attempts") - F.col("success") - F.col("failure")) / F.col("attempts")
    score = rate * 100 - F.least(F.col("trips") * 10, F.lit(30)) - F.least(retries * 20, F.lit(20.0))
    return d.withColumn("rate", rate).withColumn("reliability", F.greatest(F.lit(0.0), score))


def error_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("service", "event").agg(F.count("*").alias("n"))


BUDGETS = {"scoring": 0.3, "consensus": 0.1, "term_mining": 0.4, "normalization": 0.1}  # fixed values: real-time factor targets


def rtf_report(usage: DataFrame) -> DataFrame:
    """Real-time factor per stage against its target; over budget beyond 1.2 x target.  ``usage``: run_id, stage, duration, audio."""
    target = F
    for s, t in BUDGETS.items():
        target = target.when(F.col("stage") == s, t)
    d = usage.withColumn("target", target.otherwise(1.0)).withColumn("rtf", F.when(F.col("audio") > 0, F.col("duration") / F.col("audio")).otherwise(0.0))
    over = F.round(F.col("rtf") - F.col("target") * 1.2, 9) > 0
    m = d.groupBy("run_id").agg(F.count("*").alias("stages"), F.count(F.when(over, 1)).alias("over"), F.avg("rtf").alias("mean_rtf"), F.max("rtf").alias("max_rtf"))
    c = 1.0 - F.col("over") / F.col("stages")
    r = F.round(c * 100, 9)
    return m.withColumn("compliance", c).withColumn("grade", F.when(r >= 90, "A").when(r >= 80, "B").when(r >= 70, "C").when(r >= 60, "D").otherwise("F"))


def validate_manifest(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings per run: inputs nobody produces and hashes held by several artifacts.

    ``artifacts``: run_id, name, sha; ``edges``: run_id, name, input.
    """
    produced = artifacts.select("run_id", F.col("name").alias("input")).distinct()
    missing = edges.join(produced, ["run_id", "input"], "left_anti").groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit("missing_input").alias("finding"), "n")
    twins = artifacts.groupBy("run_id", "sha").agg(F.countDistinct("name").alias("k")).where("k > 1").groupBy("run_id").agg(F.sum("k").alias("n")) \
        .select("run_id", F.lit("duplicate_hash").alias("finding"), "n")
    return missing.unionByName(twins)


def totals_mismatch(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs whose stated count or bytes differ from their artifacts.  ``runs``: run_id, files, bytes."""
    a = artifacts.groupBy("run_id").agg(F.count("*").alias("real_files"), F.sum("bytes").alias("real_bytes"))
    d = runs.join(a, "run_id", "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0))
    return d.where((z("files") != z("real_files")) | (z("bytes") != z("real_bytes"))).select("run_id", z("files").alias("files"), z("real_files").alias("real_files"), z("bytes").alias("bytes"), z("real_bytes").alias("real_bytes"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], limit_ms: float = 5.0) -> DataFrame:
    """Word sequences and clock drift of two runs.  ``a``, ``b``: keys, ordinal, word, start, end (ms)."""
    left = a.select(*keys, "ordinal", F.col("word").alias("w1"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    right = b.select(*keys, "ordinal", F.col("word").alias("w2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    d = left.join(right, [*keys, "ordinal"], "full_outer")
    m = d.groupBy(*keys).agg(
        F.count(F.when(~F.col("w1").eqNullSafe(F.col("w2")), 1)).alias("different"), F.coalesce(F.max(F.abs(F.col("s1") - F.col("s2"))), F.lit(0)).alias("start_drift"),
        F.coalesce(F.max(F.abs(F.col("e1") - F.col("e2"))), F.lit(0)).alias("end_drift"))
    return m.withColumn("same_words", F.col("different") == 0).withColumn(
        "deterministic", (F.col("different") == 0) & (F.col("start_drift") <= limit_ms) & (F.col("end_drift") <= limit_ms))


def table_diff(a: DataFrame, b: DataFrame, volatile: list[str] = ()) -> DataFrame:
    """Rows of one run missing in the other, both ways, without the volatile columns."""
    cols = [c for c in a.columns if c not in volatile]
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).withColumn("side", F.lit("only_first")).unionByName(y.exceptAll(x).withColumn("side", F.lit("only_second")))


def reconcile_inventory(data: DataFrame, meta: DataFrame) -> DataFrame:
    """Entries by state, scope and project (``*`` = all).  ``data``: key, scope, project, bytes, age_days; ``meta``: key."""
    d = data.join(meta.select("key", F.lit(True).alias("has_meta")).distinct(), "key", "full_outer")
    state = F.when(F.col("bytes").isNull(), "orphan_metadata").when(F.col("has_meta").isNull(), "orphan_data").otherwise("valid")
    m = d.withColumn("state", state).groupingSets([["state", "scope", "project"], ["state"]], "state", "scope", "project").agg(
        F.grouping("scope").alias("whole"), F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.min("age_days").alias("min_age"), F.avg("age_days").alias("avg_age"), F.max("age_days").alias("max_age"))
    name = lambda c: F.when(F.col("whole") == 1, "*").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("-")))
    return m.select("state", name("scope").alias("scope"), name("project").alias("project"), "entries", "bytes", "min_age", "avg_age", "max_age")


def eviction_plan(inventory: DataFrame, cap: int, order: list[str], bucket: Column, stale_days: int = 30) -> DataFrame:
    """Per project the oldest entries until the rest fits the cap, and everything stale.  ``inventory``: project, key, bytes, age_days."""
    d = scan_over(inventory, ["project"], order, bucket, before={"freed": ("sum", F.col("bytes"))})
    d = attach(d, ["project"], total=F.sum("bytes"))
    over = F.coalesce("freed", F.lit(0)) < F.col("total") - cap
    stale = F.col("age_days") > stale_days
    return d.where(over | stale).select("project", "key", "bytes", F.when(stale, "stale").otherwise("over_cap").alias("reason"))


def lineage(edges: DataFrame, roots: DataFrame, fold: int = 16) -> DataFrame:
    """Every artifact reachable from the roots with its least depth, level by level.  ``edges``: name, input; ``roots``: name.

    Each step joins only the new frontier and drops what is already known, so cycles end and the depth needs no limit;
    lineage is cut with reliable checkpoints, and the known levels become one table again every ``fold`` levels.
    """
    known = cut_lineage(roots.select(F.col("name").alias("root"), "name").distinct().withColumn("depth", F.lit(0)))
    frontier = known
    for depth in count(1):
        step = frontier.select("root", "name").join(edges, "name").select("root", F.col("input").alias("name")).distinct() \
            .join(known.select("root", "name"), ["root", "name"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if depth % fold == 0:
            known = cut_lineage(known)
    return known


def cycles(edges: DataFrame, keys: list[str], steps: int = 3) -> DataFrame:
    """Artifacts that depend on themselves: keys, name, cycle (the least name of the strongly connected component), size.

    ``edges``: keys, name, input.  Edges that no cycle can use (nothing comes in, or nothing goes out) are trimmed first.  Then every node takes the
    greatest name that reaches it as its colour; of the nodes of one colour, those that reach the one the colour is named after are a component.
    Components leave the graph and the rest goes on.  Every join is by (keys, name), ``steps`` of them between two checkpoints; only counts come to
    the driver.
    """
    keys = list(keys)
    e = cut_lineage(edges.where("name is not null and input is not null").select(*keys, F.col("name").alias("a"), F.col("input").alias("b")).distinct())
    loops = e.where("a = b").select(*keys, F.col("a").alias("name"), F.lit(True).alias("self"))
    found, left = None, e.count()
    while left:
        before = left + 1
        while left and left < 0.9 * before or before == left + 1:  # as long as trimming takes a tenth away
            before = left
            e = cut_lineage(e.join(e.select(*keys, F.col("a").alias("b")).distinct(), [*keys, "b"], "left_semi").join(e.select(*keys, F.col("b").alias("a")).distinct(), [*keys, "a"], "left_semi").select(*keys, "a", "b"))
            left = e.count()
        if not left:
            break
        nodes = e.select(*keys, F.col("a").alias("name")).union(e.select(*keys, "b")).distinct()
        colour = settled(nodes.withColumn("c", F.col("name")), lambda d: d.select(*keys, "name", "c").unionByName(
            d.join(e.select(*keys, F.col("a").alias("name"), "b"), [*keys, "name"]).select(*keys, F.col("b").alias("name"), "c")).groupBy(*keys, "name").agg(F.max("c").alias("c")), keys, steps)
        inner = e.join(colour.select(*keys, F.col("name").alias("a"), F.col("c").alias("ca")), [*keys, "a"]).join(colour.select(*keys, F.col("name").alias("b"), F.col("c").alias("cb")), [*keys, "b"]).where("ca = cb")
        inner = cut_lineage(inner.select(*keys, F.col("b").alias("name"), "a", "ca"))
        members = settled(colour.where("name = c"), lambda d: d.unionByName(d.join(inner, [*keys, "name"]).select(*keys, F.col("a").alias("name"), F.col("ca").alias("c"))).distinct(), keys, steps)
        found = members if found is None else found.unionByName(members)
        gone = members.select(*keys, "name")
        for side in ("a", "b"):
            e = e.join(gone.withColumnRenamed("name", side), [*keys, side], "left_anti")
        e = cut_lineage(e.select(*keys, "a", "b"))
        left = e.count()
    if found is None:
        return loops.select(*keys, "name", F.col("name").alias("cycle"), F.lit(1).cast("bigint").alias("size")).limit(0)
    groups = found.groupBy(*keys, "c").agg(F.min("name").alias("cycle"), F.count("*").alias("size"))
    d = found.join(groups, [*keys, "c"]).join(loops, [*keys, "name"], "left")
    return d.where("size > 1 or self").select(*keys, "name", "cycle", "size")


def settled(d: DataFrame, step, keys: list[str], steps: int) -> DataFrame:
    """Apply ``step`` until the rows (keys, name, c) stay the same."""
    state = None
    while True:
        for _ in range(steps):
            d = step(d)
        d = cut_lineage(d)
        now = d.agg(F.count("*"), F.sum(F.xxhash64(*keys, "name", "c").cast("decimal(38,0)"))).first()
        if now == state:
            return d
        state = now
