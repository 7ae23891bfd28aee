"""Streams replayed over files, late and repeated batches included, against the SQL of their batch twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from chorale.functions.numeric import r6
from chorale.operators import calibration as cal, terms as tm
from chorale.plans.consensus import CONTEXT_SQL, _UNPIVOT, in_context
from chorale.plans.evaluate import ECE
from chorale.plans.io import WIN, new_folder
from chorale.plans.registry import query
from chorale.plans.terms import TB, base_and_session, deny
from chorale.streaming import metrics as st, replay as rp
from chorale.views import with_views

#: Seconds of one delivery, and how long the watermark waits.
SPAN, LATE = 432_000, "5 days"

LATE_SQL = with_views("metric") + f""", sl AS (SELECT *, CAST(floor((epoch(ts)-1704067200)/{SPAN}) AS BIGINT) AS slot FROM metric), lt AS (SELECT * FROM sl WHERE NOT (event_id%10=7 AND slot<=(SELECT max(slot) FROM sl)-3))
 SELECT name, CAST(floor(epoch(ts)/86400)*86400 AS BIGINT) AS start, count(*) AS n, round(avg(value),6) AS avg, max(value) AS max, min(value) AS min FROM lt GROUP BY 1,2"""


@query("I6_late_data", LATE_SQL)
def _(v):
    """A tenth of the rows comes one delivery late, inside the watermark, and counts; another comes four deliveries late and is dropped
    where the watermark has passed its window."""
    slot = F.floor((F.unix_micros("ts") / 1e6 - 1704067200) / SPAN)
    d = v.metric.withColumn("slot", slot)
    last = d.agg(F.max("slot")).first()[0]
    if last is None:
        return st.metric_windows(v.metric, "1 day", "1 day").select("name", F.unix_timestamp("start").alias("start"), "n", "avg", "max", "min")
    wait = F.when(F.col("event_id") % 10 == 3, 1).when((F.col("event_id") % 10 == 7) & (F.col("slot") <= last - 3), 4).otherwise(0)
    folder = new_folder(v)
    rows = d.withColumn("delivery", F.col("slot") + wait).drop("slot")
    first = d.agg(F.min("slot")).first()[0]
    rp.deliver(rows, F.col("delivery"), range(first, last + 2), folder, lambda s: st.metric_windows(s, "1 day", "1 day", LATE), rp.twice(rp.window_batches(f"{folder}/out")), "update")
    w = rp.latest_windows(v.spark, f"{folder}/out", ["name", "start"])
    return w.select("name", F.unix_timestamp("start").alias("start"), "n", r6("avg").alias("avg"), "max", "min")


@query("I5_calibration_stream", with_views("calib") + """, cl AS (SELECT concat('g',provider[4:4]) AS provider, doc_id, raw, label FROM calib QUALIFY row_number() OVER (PARTITION BY concat('g',provider[4:4]) ORDER BY doc_id DESC)<=1000)""" + ECE.replace("{k}", "provider").replace("{t}", "cl")
       + " SELECT provider, samples, round(coalesce(gap,0)/samples,6) AS ece, round(bias,6) AS bias, CASE WHEN samples>=50 AND gap/samples>15e-2 THEN CASE WHEN gap/samples>2e-1 THEN 'high' ELSE 'medium' END END AS ece_alert, samples>=50 AND abs(bias)>1e-1 AS bias_alert FROM em LEFT JOIN eg USING (provider)")
def _(v):
    """Three deliveries that cut across the order of the events; every batch is written twice."""
    d = v.calib.select(F.concat(F.lit("g"), F.substring("provider", 4, 1)).alias("provider"), "doc_id", "raw", "label", F.timestamp_seconds("doc_id").alias("ts"))
    folder = new_folder(v)
    rp.deliver(d, F.col("doc_id") % 3, range(3), folder, lambda s: s, rp.twice(st.foreach_batch_calibration(f"{folder}/out")))
    last = st._latest(v.spark, f"{folder}/out/alerts", 1 << 62)
    return last.withColumn("ece", r6("ece")).withColumn("bias", r6("bias"))


@query("I7_registry_stream", with_views("cand") + CONTEXT_SQL + _UNPIVOT + """ SELECT coalesce(domain,'*') AS domain, coalesce(speaker_range,'*') AS speaker_range, coalesce(noise,'*') AS noise, dim, count(*) AS n, round(avg(x),6) AS mean, round(min(x),6) AS min, round(max(x),6) AS max
 FROM up GROUP BY GROUPING SETS ((domain,speaker_range,noise,dim),(dim))""")
def _(v):
    folder = new_folder(v)
    rp.deliver(in_context(v), F.col("session_id") % 3, range(3), folder, lambda s: s, rp.twice(st.foreach_batch_registry(f"{folder}/out")))
    last = st._latest(v.spark, f"{folder}/out", 1 << 62)
    return last.select(*cal.CONTEXT, "dim", "n", *[r6(c).alias(c) for c in ("mean", "min", "max")])


@query("I7_term_stream", TB + " SELECT project_id, status, count(*) AS n FROM mr GROUP BY 1,2")
def _(v):
    """One delivery of session terms merges into the base; its second writing starts from the same base."""
    base, session = base_and_session(v)
    folder, banned = new_folder(v), deny(v)
    merge = lambda old, batch: tm.merge_counts(tm.merge_term_base(base, batch, banned))
    rp.deliver(session, F.lit(0), range(1), folder, lambda s: s, rp.twice(st.foreach_batch_terms(f"{folder}/out", merge)))
    return st._latest(v.spark, f"{folder}/out", 1 << 62)


@query("A9_term_snapshots", TB + """ SELECT project_id, status, count(*) AS n, round(sum(mean),6) AS mean FROM mr GROUP BY 1,2""")
def _(v):
    """Base and session terms as committed versions, read back and merged; a version without its marker is passed over."""
    base, session = base_and_session(v)
    folder = new_folder(v)
    rp.write_snapshot(base, f"{folder}/base", 1, "project_id")
    rp.write_snapshot(session, f"{folder}/session", 1, "project_id")
    merged = tm.merge_term_base(rp.read_snapshot(v.spark, f"{folder}/base"), rp.read_snapshot(v.spark, f"{folder}/session"), deny(v))
    rp.write_snapshot(merged, f"{folder}/base", 2, "project_id")
    rp.write_snapshot(rp.read_snapshot(v.spark, f"{folder}/base", 1), f"{folder}/base", 3, "project_id")
    marker = v.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/base/version=3/_SUCCESS")
    marker.getFileSystem(v.spark._jsc.hadoopConfiguration()).delete(marker, False)
    return rp.read_snapshot(v.spark, f"{folder}/base").groupBy("project_id", "status").agg(F.count("*").alias("n"), r6(F.sum("mean")).alias("mean"))


@query("I1_metric_stream", WIN + " SELECT name, CAST(epoch(ws) AS BIGINT) AS start, n, round(av,6) AS avg, round(sm,6) AS sum, mx AS max, mn AS min, round(p95,6) AS p95, round(p99,6) AS p99 FROM q")
def _(v):
    """Three deliveries in order of time, and one value long after them that closes every window."""
    d = v.metric
    span = d.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    third = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(span.a))) * 3 / (F.unix_micros(F.lit(span.b)) - F.unix_micros(F.lit(span.a)) + 1)), F.lit(2))
    end = d.select(F.max(F.col("event_id")).alias("event_id"), (F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit("~end").alias("name"), F.lit("~").alias("component"), F.lit(0.0).alias("value"))
    rows = d.withColumn("slot", third).unionByName(end.withColumn("slot", F.lit(3).cast("bigint")))
    folder = new_folder(v)
    rp.deliver(rows, F.col("slot"), range(4), folder, lambda s: st.metric_windows_final(s, "86400 seconds", "8640 seconds", "1 hour"), rp.twice(rp.window_batches(f"{folder}/out")))
    w = v.spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/out")
    return w.select("name", F.unix_timestamp("start").alias("start"), "n", "max", "min", *[r6(c).alias(c) for c in ("avg", "sum", "p95", "p99")])
