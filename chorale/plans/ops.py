"""Cost, reliability, budget, manifest, run-comparison, inventory and lineage queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from chorale.functions.numeric import r6
from chorale.operators import ops as op
from chorale.plans.registry import query
from chorale.views import WORDS, with_views

# fixed values: price list
PRICES = [("whisper-1", 0.006, 0.0, 0.0), ("gpt-4", 0.0, 0.03, 0.06), ("gpt-3.5-turbo", 0.0, 0.002, 0.002)]


@query("D15_cost_summary", with_views("retry") + """, c AS (SELECT service, (['whisper-1','gpt-4','gpt-3.5-turbo'])[event_id%3+1] AS model, duration_ms AS duration, CASE WHEN event_id%3=0 THEN duration_ms*6 ELSE 0 END AS au, CASE WHEN event_id%3>0 THEN event_id%700 ELSE 0 END AS ti, CASE WHEN event_id%3>0 THEN event_id%300 ELSE 0 END AS tou FROM retry),
 k AS (SELECT *, au/60*CASE model WHEN 'whisper-1' THEN 6e-3 ELSE 0 END + ti/1e3*CASE model WHEN 'gpt-4' THEN 3e-2 WHEN 'gpt-3.5-turbo' THEN 2e-3 ELSE 0 END + tou/1e3*CASE model WHEN 'gpt-4' THEN 6e-2 WHEN 'gpt-3.5-turbo' THEN 2e-3 ELSE 0 END AS cost FROM c)
 SELECT coalesce(service,'*') AS service, coalesce(model,'*') AS model, count(*) AS calls, round(sum(cost),6) AS cost, round(sum(duration),6) AS duration, CAST(sum(ti+tou) AS BIGINT) AS tokens, round(sum(cost)/count(*),6) AS cost_per_call FROM k GROUP BY ROLLUP (service, model)""")
def _(v):
    names = F.array(*[F.lit(p[0]) for p in PRICES])
    kind = F.col("event_id") % 3
    calls = v.retry.select("service", F.element_at(names, (kind + 1).cast("int")).alias("model"), F.col("duration_ms").alias("duration"),
                           F.when(kind == 0, F.col("duration_ms") * 6).otherwise(0.0).alias("audio_seconds"), F.when(kind > 0, F.col("event_id") % 700).otherwise(0).alias("input_tokens"),
                           F.when(kind > 0, F.col("event_id") % 300).otherwise(0).alias("output_tokens"))
    prices = v.spark.createDataFrame(PRICES, "model string, per_minute double, per_1k_input double, per_1k_output double")
    d = op.cost_summary(calls, prices)
    return d.select("service", "model", "calls", "tokens", *[r6(c).alias(c) for c in ("cost", "duration", "cost_per_call")])


@query("D16_service_reliability", with_views("retry") + """, d AS (SELECT service, count(*) AS attempts, count(*) FILTER (event='success') AS success, count(*) FILTER (event='failure') AS failure, count(*) FILTER (event='exhausted') AS trips, sum(CASE WHEN event='attempt' THEN duration_ms ELSE 0 END) AS retry_ms, max(attempt) AS max_attempt, avg(duration_ms) FILTER (event='success') AS sm FROM retry GROUP BY 1)
 SELECT service, attempts, success, failure, trips, max_attempt, round(retry_ms,6) AS retry_ms, round(sm,6) AS success_mean_ms, round(success/attempts,6) AS rate, round(greatest(0,success/attempts*100-least(trips*10,30)-least((attempts-success-failure)/attempts*20,20)),6) AS reliability FROM d""")
def _(v):
    d = op.service_reliability(v.retry)
    return d.select("service", "attempts", "success", "failure", "trips", "max_attempt", *[r6(c).alias(c) for c in ("retry_ms", "success_mean_ms", "rate", "reliability")])


@query("D16_error_histogram", with_views("retry") + " SELECT service, event, count(*) AS n FROM retry GROUP BY 1,2")
def _(v):
    return op.error_histogram(v.retry)


STAGES = list(op.BUDGETS)


@query("D26_rtf_report", with_views("ivl") + """, u AS (SELECT session_id AS run_id, (['scoring','consensus','term_mining','normalization'])[event_id%4+1] AS stage, event_id%97/1e2 AS rtf, ([3e-1,1e-1,4e-1,1e-1])[event_id%4+1] AS target FROM ivl), m AS (SELECT run_id, count(*) AS stages, count(*) FILTER (round(rtf-target*12e-1,9)>0) AS ov, avg(rtf) AS mean_rtf, max(rtf) AS max_rtf FROM u GROUP BY 1), g AS (SELECT *, round((1-ov/stages)*100,9) AS r FROM m)
 SELECT run_id, stages, ov AS "over", round(mean_rtf,6) AS mean_rtf, round(max_rtf,6) AS max_rtf, round(1-ov/stages,6) AS compliance, CASE WHEN r>=90 THEN 'A' WHEN r>=80 THEN 'B' WHEN r>=70 THEN 'C' WHEN r>=60 THEN 'D' ELSE 'F' END AS grade FROM g""")
def _(v):
    names = F.array(*[F.lit(s) for s in STAGES])
    u = v.ivl.select(F.col("session_id").alias("run_id"), F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("stage"), (F.col("event_id") % 97 / 100.0).alias("duration"), F.lit(1.0).alias("audio"))
    d = op.rtf_report(u)
    return d.select("run_id", "stages", "over", "grade", *[r6(c).alias(c) for c in ("mean_rtf", "max_rtf", "compliance")])


ART = """WITH ar AS (SELECT l_orderkey AS run_id, concat('a',l_partkey%7) AS name, concat('h',l_suppkey%5) AS sha, CAST(l_quantity AS BIGINT) AS bytes FROM lineitem), ed AS (SELECT l_orderkey AS run_id, concat('a',l_partkey%7) AS name, concat('a',l_suppkey%9) AS input FROM lineitem)"""


def artifacts(v):
    li = v.table("lineitem")
    a = li.select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("a"), F.col("l_partkey") % 7).alias("name"), F.concat(F.lit("h"), F.col("l_suppkey") % 5).alias("sha"), F.col("l_quantity").cast("bigint").alias("bytes"))
    e = li.select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("a"), F.col("l_partkey") % 7).alias("name"), F.concat(F.lit("a"), F.col("l_suppkey") % 9).alias("input"))
    return a, e


@query("C16_validate_manifest", ART + """, m AS (SELECT run_id, count(*) AS n FROM ed WHERE NOT EXISTS (SELECT 1 FROM ar WHERE ar.run_id=ed.run_id AND ar.name=ed.input) GROUP BY 1), t AS (SELECT run_id, CAST(sum(k) AS BIGINT) AS n FROM (SELECT run_id, sha, count(DISTINCT name) AS k FROM ar GROUP BY 1,2 HAVING count(DISTINCT name)>1) GROUP BY 1)
 SELECT run_id, 'missing_input' AS finding, n FROM m UNION ALL SELECT run_id, 'duplicate_hash', n FROM t""")
def _(v):
    return op.validate_manifest(*artifacts(v))


@query("C16_totals_mismatch", ART + """, r AS (SELECT o_orderkey AS run_id, 1+o_orderkey%7 AS files, o_orderkey%200 AS bytes FROM orders), a AS (SELECT run_id, count(*) AS rf, CAST(sum(bytes) AS BIGINT) AS rb FROM ar GROUP BY 1), j AS (SELECT coalesce(r.run_id,a.run_id) AS run_id, coalesce(files,0) AS files, coalesce(rf,0) AS real_files, coalesce(bytes,0) AS bytes, coalesce(rb,0) AS real_bytes FROM r FULL JOIN a ON a.run_id=r.run_id) SELECT * FROM j WHERE files<>real_files OR bytes<>real_bytes""")
def _(v):
    runs = v.table("orders").select(F.col("o_orderkey").alias("run_id"), (1 + F.col("o_orderkey") % 7).alias("files"), (F.col("o_orderkey") % 200).alias("bytes"))
    return op.totals_mismatch(artifacts(v)[0], runs)


RUNS = with_views("word") + """, a AS (SELECT session_id, turn*4294967296+pos AS ordinal, word, start_ms AS s, end_ms AS e FROM word), b AS (SELECT session_id, turn*4294967296+pos AS ordinal, CASE WHEN session_id%10=3 AND pos=5 THEN 'x' ELSE word END AS word, start_ms+(session_id%7) AS s, end_ms AS e FROM word WHERE NOT (session_id%10=4 AND pos=2))"""


def two_runs(v):
    o = F.col("turn") * WORDS + F.col("pos")
    a = v.word.select("session_id", o.alias("ordinal"), "word", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    b = v.word.where("not (session_id % 10 = 4 and pos = 2)").select(
        "session_id", o.alias("ordinal"), F.when((F.col("session_id") % 10 == 3) & (F.col("pos") == 5), "x").otherwise(F.col("word")).alias("word"),
        (F.col("start_ms") + F.col("session_id") % 7).alias("start"), F.col("end_ms").alias("end"))
    return a, b


@query("C17_compare_runs", RUNS + """, j AS (SELECT coalesce(a.session_id,b.session_id) AS session_id, a.word AS w1, b.word AS w2, abs(a.s-b.s) AS sd, abs(a.e-b.e) AS ed FROM a FULL JOIN b ON a.session_id=b.session_id AND a.ordinal=b.ordinal), m AS (SELECT session_id, count(*) FILTER (w1 IS DISTINCT FROM w2) AS different, coalesce(max(sd),0) AS start_drift, coalesce(max(ed),0) AS end_drift FROM j GROUP BY 1)
 SELECT *, different=0 AS same_words, different=0 AND start_drift<=5 AND end_drift<=5 AS deterministic FROM m""")
def _(v):
    return op.compare_runs(*two_runs(v), ["session_id"])


@query("G4_table_diff", RUNS + """ SELECT session_id, ordinal, word, 'only_first' AS side FROM (SELECT session_id, ordinal, word FROM a EXCEPT ALL SELECT session_id, ordinal, word FROM b) UNION ALL SELECT session_id, ordinal, word, 'only_second' FROM (SELECT session_id, ordinal, word FROM b EXCEPT ALL SELECT session_id, ordinal, word FROM a)""")
def _(v):
    return op.table_diff(*two_runs(v), volatile=["start", "end"])


INV = """WITH da AS (SELECT o_orderkey AS key, o_orderstatus AS scope, concat('p',o_custkey%5) AS project, CAST(floor(o_totalprice) AS BIGINT) AS bytes, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS age_days FROM orders), me AS (SELECT DISTINCT l_orderkey+100 AS key FROM lineitem)"""


def inventory(v):
    return v.table("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("scope"), F.concat(F.lit("p"), F.col("o_custkey") % 5).alias("project"), F.floor("o_totalprice").alias("bytes"),
                                    F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate")).cast("bigint").alias("age_days"))


@query("C18_reconcile_inventory", INV + """, j AS (SELECT scope, project, bytes, age_days, CASE WHEN da.key IS NULL THEN 'orphan_metadata' WHEN me.key IS NULL THEN 'orphan_data' ELSE 'valid' END AS state FROM da FULL JOIN me ON da.key=me.key)
 SELECT state, CASE WHEN grouping(scope)=1 THEN '*' ELSE coalesce(scope,'-') END AS scope, CASE WHEN grouping(scope)=1 THEN '*' ELSE coalesce(project,'-') END AS project, count(*) AS entries, CAST(coalesce(sum(bytes),0) AS BIGINT) AS bytes, min(age_days) AS min_age, round(avg(age_days),6) AS avg_age, max(age_days) AS max_age FROM j GROUP BY GROUPING SETS ((state,scope,project),(state))""")
def _(v):
    meta = v.table("lineitem").select((F.col("l_orderkey") + 100).alias("key")).distinct()
    return op.reconcile_inventory(inventory(v), meta).withColumn("avg_age", r6("avg_age"))


@query("F14_eviction_plan", INV + """, o AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY project ORDER BY age_days DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS freed, sum(bytes) OVER (PARTITION BY project) AS total FROM da)
 SELECT project, key, bytes, CASE WHEN age_days>1200 THEN 'stale' ELSE 'over_cap' END AS reason FROM o WHERE freed<total-100000000 OR age_days>1200""")
def _(v):
    inv = inventory(v).withColumn("newness", -F.col("age_days"))
    return op.eviction_plan(inv, 100_000_000, ["newness", "key"], F.floor(F.col("newness") / 30), 1200)


@query("H52_lineage", """WITH RECURSIVE ed AS (SELECT DISTINCT l_partkey AS name, l_suppkey AS input FROM lineitem), w AS (SELECT n_nationkey::BIGINT AS root, n_nationkey::BIGINT AS name FROM nation UNION SELECT w.root, ed.input FROM w JOIN ed ON ed.name=w.name) SELECT root, name FROM w""")
def _(v):
    edges = v.table("lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("input")).distinct()
    roots = v.table("nation").select(F.col("n_nationkey").cast("bigint").alias("name"))
    return op.lineage(edges, roots).select("root", "name")


@query("H52_cycles", ART.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT DISTINCT run_id, name, input FROM ed), r AS (SELECT run_id, name, input FROM e UNION SELECT r.run_id, r.name, e.input FROM r JOIN e ON e.run_id=r.run_id AND e.name=r.input)
 SELECT x.run_id, x.name, min(y.name) AS cycle, count(DISTINCT y.name) AS size FROM r x JOIN r y ON x.run_id=y.run_id AND x.name=y.input AND x.input=y.name GROUP BY 1,2""")
def _(v):
    return op.cycles(artifacts(v)[1], ["run_id"])
