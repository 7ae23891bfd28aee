"""Evaluation, calibration and trend queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from chorale.functions import entities as ent
from chorale.functions.numeric import r6
from chorale.operators import evaluate as op
from chorale.plans.registry import query
from chorale.plans.speech import _ent_sql
from chorale.plans.turns import HOURS4, HS, IV, MS, SG, US, WIDTH, hs, hyp_words, iv, sg
from chorale.session import cut_lineage
from chorale.views import WORDS, with_views


def text_pairs(v):
    ref = v.seg.select("session_id", "turn", F.col("text").alias("ref"))
    return hs(v).select("session_id", "turn", "engine", "confidence", F.col("text").alias("hyp")).join(ref, ["session_id", "turn"])


NORM = r"trim(regexp_replace(regexp_replace(lower({x}),'[^\p{L}\p{N}_\s]','','g'),'\s+',' ','g'))"


def _norm(x):
    return "regexp_replace(" + NORM.replace("{x}", x) + ",'[^ -~]','?','g')"


def _words(x):
    n = NORM.replace("{x}", x)
    return f"CASE WHEN {n}='' THEN [] ELSE string_split({n},' ') END"


def edits_sql(pairs: str, keys: str) -> str:
    """``we``: keys, n, m, hits, subs, dels, ins and rates of the rows (keys, ref, hyp) of the table ``pairs``: what both share at their
    ends is cut off, then the table of edits row by row; an edit weighs 100000 and a substitution one more."""
    shared = "coalesce(list_position(list_transform(range(1,least(len({a}),len({b}))+1), lambda i: {a}[i]={b}[i]),false)-1,least(len({a}),len({b})))"
    return f""", t0 AS MATERIALIZED (SELECT {keys}, row_number() OVER () AS pid, {_words('ref')} AS a, {_words('hyp')} AS b FROM {pairs}), t1 AS (SELECT {keys}, pid, len(a) AS n, len(b) AS m, list_reverse(a[{shared.format(a='a', b='b')}+1:]) AS a, list_reverse(b[{shared.format(a='a', b='b')}+1:]) AS b FROM t0),
 tp AS MATERIALIZED (SELECT {keys}, pid, n, m, a[{shared.format(a='a', b='b')}+1:] AS a, b[{shared.format(a='a', b='b')}+1:] AS b FROM t1), aw AS MATERIALIZED (SELECT pid, unnest(range(1,len(a)+1)) AS i, unnest(a) AS w FROM tp),
 bw AS MATERIALIZED (SELECT pid, 0 AS j, CAST(NULL AS VARCHAR) AS w FROM tp UNION ALL SELECT pid, unnest(range(1,len(b)+1)), unnest(b) FROM tp), dp AS (SELECT pid, CAST(0 AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(j*100000 AS BIGINT) AS v FROM bw
 UNION ALL SELECT pid, i, j, CAST(min(x) OVER (PARTITION BY pid ORDER BY j)+j*100000 AS BIGINT) FROM (SELECT dp.pid, aw.i, dp.j, least(v+100000, coalesce(lag(v) OVER (PARTITION BY dp.pid ORDER BY dp.j)+CASE WHEN bw.w=aw.w THEN 0 ELSE 100001 END, 1000000000000))-dp.j*100000 AS x
  FROM dp JOIN aw ON aw.pid=dp.pid AND aw.i=dp.i+1 JOIN bw ON bw.pid=dp.pid AND bw.j=dp.j) q),
 de AS MATERIALIZED (SELECT {keys}, n, m, v//100000 AS c, v%100000 AS subs FROM dp JOIN tp USING (pid) WHERE i=len(a) AND j=len(b)), dd AS (SELECT *, (c-subs+n-m)//2 AS dels FROM de),
 we AS MATERIALIZED (SELECT *, n-subs-dels AS hits, c-subs-dels AS ins, c/greatest(n,1) AS wer, c/greatest(c+n-subs-dels,1) AS mer, (n-subs-dels)/greatest(n,1)*(n-subs-dels)/greatest(m,1) AS wip FROM dd)"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


OWN = HS + ", own AS (SELECT hs.session_id, hs.turn, hs.engine, hs.confidence, seg.text AS ref, hs.text AS hyp FROM hs JOIN seg ON seg.session_id=hs.session_id AND seg.turn=hs.turn)"


@query("H41_wer", recursive(OWN) + edits_sql("own", "session_id, turn, engine") + """ SELECT session_id, turn, engine, CAST(hits AS INTEGER) AS hits, CAST(subs AS INTEGER) AS subs, CAST(dels AS INTEGER) AS dels, CAST(ins AS INTEGER) AS ins,
 round(wer,6) AS wer, round(mer,6) AS mer, round(1-wip,6) AS wil, round(wip,6) AS wip FROM we""")
def _(v):
    d = op.wer(text_pairs(v).drop("confidence"))
    return d.select("session_id", "turn", "engine", "hits", "subs", "dels", "ins", *[r6(c).alias(c) for c in ("wer", "mer", "wil", "wip")])


@query("H41_cer", HS + f" SELECT hs.session_id, hs.turn, engine, round(levenshtein({_norm('seg.text')},{_norm('hs.text')})/greatest(length({_norm('seg.text')}),1),6) AS cer FROM hs JOIN seg ON seg.session_id=hs.session_id AND seg.turn=hs.turn")
def _(v):
    mask = lambda c: F.regexp_replace(op.clean_text(F.col(c)), "[^ -~]", "?")  # noqa: E731  (DuckDB counts bytes)
    return text_pairs(v).select("session_id", "turn", "engine", r6(op.cer(mask("ref"), mask("hyp"))).alias("cer"))


REGIONS = recursive(with_views("hyp")) + """, rg AS (SELECT session_id, turn AS region_id, start_ms+1000 AS r0, start_ms+9000 AS r1 FROM seg),
 rt AS (SELECT rg.session_id, region_id, string_agg(word,' ' ORDER BY w.start_ms, w.turn*4294967296+w.pos) AS ref FROM rg JOIN word w ON w.session_id=rg.session_id AND w.start_ms<r1 AND w.end_ms>r0 GROUP BY 1,2),
 ht AS (SELECT rg.session_id, region_id, string_agg(word,' ' ORDER BY w.start_ms, w.turn*4294967296+w.pos) AS hyp FROM rg JOIN hyp w ON w.session_id=rg.session_id AND w.start_ms<r1 AND w.end_ms>r0 AND w.engine=1 GROUP BY 1,2),
 rh AS (SELECT session_id, region_id, coalesce(ref,'') AS ref, coalesce(hyp,'') AS hyp FROM rt FULL JOIN ht USING (session_id, region_id))"""


@query("H41_overlap_wer", REGIONS + edits_sql("rh", "session_id, region_id") + """ SELECT session_id, region_id, CAST(hits AS INTEGER) AS hits, CAST(subs AS INTEGER) AS subs, CAST(dels AS INTEGER) AS dels, CAST(ins AS INTEGER) AS ins, round(wer,6) AS wer FROM we""")
def _(v):
    ref = v.word.select("session_id", (F.col("turn") * WORDS + F.col("pos")).alias("word_id"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "word")
    hyp = hyp_words(v, 1).select("session_id", "word_id", "start", "end", "word")
    regions = v.seg.select("session_id", F.col("turn").alias("region_id"), (F.col("start_ms") + 1000).alias("r0"), (F.col("start_ms") + 9000).alias("r1"))
    d = op.overlap_wer(ref, hyp, regions, WIDTH)
    return d.select("session_id", "region_id", "hits", "subs", "dels", "ins", r6("wer").alias("wer"))


def ref_hyp(v):
    r = sg(v)
    h = r.select("session_id", "id", F.concat(F.lit("h_"), "speaker").alias("speaker"), (F.col("start") + 200 * (F.col("id") % 3)).alias("start"), (F.col("end") - 300 * (F.col("id") % 4)).alias("end")) \
        .withColumn("speaker", F.when(F.col("id") % 5 == 4, "h_user").otherwise(F.col("speaker"))).where("end > start")
    return r, h


@query("H42_der_parts", SG + """, hy AS (SELECT session_id, id, CASE WHEN id%5=4 THEN 'h_user' ELSE concat('h_',speaker) END AS speaker, start+200*(id%3) AS start, "end"-300*(id%4) AS "end" FROM sg WHERE "end"-300*(id%4)>start+200*(id%3)),
 ed AS (SELECT session_id, start AS t FROM sg UNION SELECT session_id, "end" FROM sg UNION SELECT session_id, start FROM hy UNION SELECT session_id, "end" FROM hy), ce AS (SELECT * FROM (SELECT session_id, t AS c0, lead(t) OVER (PARTITION BY session_id ORDER BY t) AS c1 FROM ed) WHERE c1>c0),
 n AS (SELECT ce.*, (SELECT count(DISTINCT speaker) FROM sg WHERE sg.session_id=ce.session_id AND sg.start<c1 AND sg."end">c0) AS nr, (SELECT count(DISTINCT speaker) FROM hy WHERE hy.session_id=ce.session_id AND hy.start<c1 AND hy."end">c0) AS nh FROM ce)
 SELECT session_id, round(sum(nr*(c1-c0))/1e3,6) AS reference, round(sum(greatest(nr-nh,0)*(c1-c0))/1e3,6) AS missed, round(sum(greatest(nh-nr,0)*(c1-c0))/1e3,6) AS false_alarm FROM n WHERE nr+nh>0 GROUP BY 1""")
def _(v):
    d = op.der_parts(*ref_hyp(v), MS, WIDTH)
    return d.select("session_id", *[r6(c).alias(c) for c in ("reference", "missed", "false_alarm")])


@query("H42_der")
def _(v):
    d = op.der(*ref_hyp(v), MS, WIDTH)
    return d.select("session_id", *[r6(c).alias(c) for c in ("confusion", "der", "speaker_count_accuracy")])


@query("C13_entity_accuracy", _ent_sql() + """, g AS (SELECT doc_id, entity_type, lower(entity) AS e, count(*) AS c FROM e GROUP BY ALL), p AS (SELECT DISTINCT doc_id, entity_type, CASE WHEN doc_id%5=0 THEN concat(lower(entity),'~~') WHEN doc_id%2=0 THEN replace(lower(entity),'7','1') ELSE lower(entity) END AS q FROM e),
 h AS (SELECT g.*, EXISTS(SELECT 1 FROM p WHERE p.doc_id=g.doc_id AND p.entity_type=g.entity_type AND (q=e OR (abs(length(q)-length(e))<=1 AND 1-levenshtein(q,e)/greatest(length(q),length(e))>=8e-1))) AS hit FROM g)
 SELECT entity_type, CAST(sum(c) AS BIGINT) AS gold, CAST(sum(CASE WHEN hit THEN c ELSE 0 END) AS BIGINT) AS matched, round(sum(CASE WHEN hit THEN c ELSE 0 END)/sum(c),6) AS accuracy FROM h GROUP BY 1""")
def _(v):
    e = cut_lineage(ent.entity_matches(v.norm.select("doc_id", "text")))  # read four times
    pred = e.withColumn("entity", F.when(F.col("doc_id") % 5 == 0, F.concat("entity", F.lit("~~"))).when(F.col("doc_id") % 2 == 0, F.replace(F.lower("entity"), F.lit("7"), F.lit("1"))).otherwise(F.col("entity")))
    return op.entity_accuracy(e, pred, ["doc_id"]).withColumn("accuracy", r6("accuracy"))


BOTH = recursive(OWN) + ", cross_pairs AS (SELECT x.session_id, x.turn, x.engine*10+y.engine AS engine, x.hyp AS ref, y.hyp AS hyp FROM own x JOIN own y ON x.session_id=y.session_id AND x.turn=y.turn AND x.engine<y.engine), ap AS (SELECT session_id, turn, engine, ref, hyp FROM own UNION ALL SELECT session_id, turn, 1000+engine, ref, hyp FROM cross_pairs)"


@query("H43_ensemble_metrics", BOTH + edits_sql("ap", "session_id, turn, engine") + """, o AS (SELECT we.*, own.confidence FROM we JOIN own USING (session_id,turn,engine)), ac AS (SELECT session_id, engine, avg(wer) AS w FROM o GROUP BY 1,2), be AS (SELECT session_id, arg_min(engine,(w,engine)) AS best_engine, min(w) AS best_wer FROM ac GROUP BY 1),
 ag AS (SELECT session_id, avg(greatest(0,1-wer)) AS agreement FROM we WHERE engine>=1000 GROUP BY 1), co AS (SELECT session_id, corr(confidence,1-wer) AS calibration FROM o GROUP BY 1)
 SELECT session_id, best_engine, round(best_wer,6) AS best_wer, round(agreement,6) AS agreement, round(coalesce(CASE WHEN isfinite(calibration) THEN calibration END,0),6) AS calibration FROM be LEFT JOIN ag USING (session_id) JOIN co USING (session_id)""")
def _(v):
    d = op.ensemble_metrics(text_pairs(v), ["session_id", "turn"])
    return d.select("session_id", "best_engine", *[r6(c).alias(c) for c in ("best_wer", "agreement", "calibration")])


SCEN = ["baseline", "challenging_asr", "edge_case", "overlap"]


def test_metrics(v):
    names = F.array(*[F.lit(s) for s in SCEN])
    return v.table("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("test_id"), F.element_at(names, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("scenario"),
        (F.col("l_tax") / 2).alias("wer"), F.col("l_discount").alias("der"), (80 + F.col("l_quantity") / 2.5).alias("entity"), (F.col("l_suppkey") % 100 / 100.0).alias("calibration"),
        (F.col("l_partkey") % 50 / 10.0).alias("processing"), "l_shipdate", "l_orderkey", "l_returnflag")


def _gate_sql():
    parts = []
    for g, s in op.GATES.items():
        t = f"CASE scenario WHEN 'baseline' THEN {s['baseline']!r}::DOUBLE WHEN 'challenging_asr' THEN {s['hard']!r}::DOUBLE WHEN 'edge_case' THEN {s['edge_case']!r}::DOUBLE ELSE {s['other']!r}::DOUBLE END"
        m = f"{g}*100e0" if g in ("wer", "der") else g
        sign = "measured-threshold" if s["higher_is_worse"] else "threshold-measured"
        parts.append(f"SELECT *, round({sign},9) AS margin, {s['band']!r}::DOUBLE AS band FROM (SELECT test_id, scenario, rf, '{g}' AS gate, {m} AS measured, {t} AS threshold FROM tm)")
    return """WITH tm AS (SELECT concat_ws('-',l_orderkey,l_partkey,l_suppkey,l_linenumber) AS test_id, (['baseline','challenging_asr','edge_case','overlap'])[l_linenumber%4+1] AS scenario, l_returnflag AS rf, l_tax/2 AS wer, l_discount AS der, 80+l_quantity/25e-1 AS entity, l_suppkey%100/1e2 AS calibration, l_partkey%50/1e1 AS processing FROM lineitem),
 gt AS (""" + " UNION ALL ".join(parts) + "), gs AS (SELECT *, CASE WHEN margin<=0 THEN 'PASS' WHEN margin<=round(threshold*band,9) THEN 'WARNING' ELSE 'FAIL' END AS status FROM gt)"


@query("H44_apply_gates", _gate_sql() + " SELECT test_id, scenario, gate, round(measured,6) AS measured, threshold, round(margin,6) AS margin, status FROM gs")
def _(v):
    d = op.apply_gates(test_metrics(v))
    return d.withColumn("measured", r6("measured")).withColumn("margin", r6("margin"))


@query("D18_evaluation_report", _gate_sql() + """, a AS (SELECT rf AS run_id, count(*) AS gates, count(*) FILTER (status='PASS') AS passed, count(*) FILTER (status='FAIL') AS failed, count(*) FILTER (status='WARNING') AS warnings, 0::BIGINT AS errors, avg(measured) FILTER (gate='wer') AS avg_wer, max(measured) FILTER (gate='wer') AS max_wer,
 avg(measured) FILTER (gate='der') AS avg_der, max(measured) FILTER (gate='der') AS max_der, avg(measured) FILTER (gate='entity') AS avg_entity, min(measured) FILTER (gate='entity') AS min_entity FROM gs GROUP BY 1)
 SELECT run_id, gates, passed, failed, warnings, errors, round(avg_wer,6) AS avg_wer, round(max_wer,6) AS max_wer, round(avg_der,6) AS avg_der, round(max_der,6) AS max_der, round(avg_entity,6) AS avg_entity, round(min_entity,6) AS min_entity, CASE WHEN failed>0 THEN 'FAIL' WHEN warnings>0 THEN 'WARNING' ELSE 'PASS' END AS status, round(passed/gates*100,6) AS pass_rate, CASE WHEN failed>0 THEN 1 ELSE 0 END AS exit_code FROM a""")
def _(v):
    t = test_metrics(v)
    g = op.apply_gates(t.withColumn("test_id", F.concat_ws("|", "l_returnflag", "test_id"))).withColumn("run_id", F.substring_index("test_id", "|", 1))
    d = op.evaluation_report(g, ["run_id"])
    return d.select("run_id", "gates", "passed", "failed", "warnings", "errors", "status", "exit_code",
                    *[r6(c).alias(c) for c in ("avg_wer", "max_wer", "avg_der", "max_der", "avg_entity", "min_entity", "pass_rate")])


MK = ["name", "component"]


def points(v):
    return v.metric.withColumnRenamed("event_id", "seq")


@query("E14_metric_trend", with_views("metric") + """, r AS (SELECT *, row_number() OVER (PARTITION BY name,component ORDER BY ts DESC, event_id DESC) AS rk FROM metric), s AS (SELECT name, component, count(*) AS points, regr_slope(value,-rk::DOUBLE) AS slope FROM r WHERE rk<=10 GROUP BY 1,2 HAVING count(*)>=10)
 SELECT name, component, points, round(slope,6) AS slope, CASE WHEN round(slope,12)>1e-2 THEN 'increasing' WHEN round(slope,12)<-1e-2 THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def _(v):
    return op.metric_trend(points(v), MK).withColumn("slope", r6("slope"))


@query("E14_series_trend", with_views("metric") + """, r AS (SELECT *, row_number() OVER (PARTITION BY name,component ORDER BY ts, event_id) AS rk FROM metric), s AS (SELECT name, component, count(*) AS points, regr_slope(value,rk::DOUBLE) AS slope FROM r GROUP BY 1,2)
 SELECT name, component, points, round(slope,6) AS slope, CASE WHEN round(slope,12)>2e-2 THEN 'increasing' WHEN round(slope,12)<-2e-2 THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def _(v):
    return op.metric_trend(points(v), MK, None, 0.02).withColumn("slope", r6("slope"))


@query("E15_regression_first_last", with_views("metric") + """, r AS (SELECT *, row_number() OVER (PARTITION BY name,component ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY name,component ORDER BY ts DESC, event_id DESC) AS z FROM metric),
 s AS (SELECT name, component, count(*) AS points, max(CASE WHEN a=1 THEN value END) AS first, max(CASE WHEN z=1 THEN value END) AS latest, avg(value) FILTER (a<=3) AS f3, avg(value) FILTER (z<=3) AS l3 FROM r GROUP BY 1,2)
 SELECT name, component, points, round(first,6) AS "first", round(latest,6) AS latest, round(latest-first,6) AS "change", round(latest-first,9)>5e-2 AS regressed, round(l3-f3,6) AS change3 FROM s""")
def _(v):
    d = op.regression_first_last(points(v), MK, 0.05)
    return d.select(*MK, "points", "regressed", *[r6(c).alias(c) for c in ("first", "latest", "change", "change3")])


@query("E16_regression_history", with_views("metric") + """, c AS (SELECT name, component, avg(value) AS value FROM metric WHERE ts>='2024-01-30' GROUP BY 1,2), h AS (SELECT name, component, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value),0) AS std FROM metric WHERE ts<'2024-01-30' GROUP BY 1,2)
 SELECT c.name, c.component, n, round(value,6) AS "current", round(mean,6) AS mean, round(value-mean,6) AS "change", round(CASE WHEN std>0 THEN (value-mean)/std ELSE 0 END,6) AS z, value-mean>2 AS regressed, CASE WHEN abs(value-mean)>2*std THEN 'high' ELSE 'medium' END AS significance FROM c JOIN h ON h.name=c.name AND h.component=c.component""")
def _(v):
    cut = F.lit("2024-01-30").cast("timestamp")
    now = v.metric.where(F.col("ts") >= cut).groupBy(*MK).agg(F.avg("value").alias("value"))
    d = op.regression_history(now, v.metric.where(F.col("ts") < cut), MK, 2.0)
    return d.select(*MK, "n", "regressed", "significance", *[r6(c).alias(c) for c in ("current", "mean", "change", "z")])


BIN = "CAST(ceil(round(raw*10,9)) AS BIGINT)"
ECE = """, rb AS (SELECT {k}, """ + BIN + """ AS bin, count(*) AS n, avg(label) AS ac, avg(raw) AS co FROM {t} WHERE """ + BIN + """ BETWEEN 1 AND 10 GROUP BY ALL), eg AS (SELECT {k}, sum(n*abs(ac-co)) AS gap FROM rb GROUP BY ALL), em AS (SELECT {k}, count(*) AS samples, avg((raw-label)*(raw-label)) AS brier, stddev_pop(raw) AS sharpness, avg(raw)-avg(label) AS bias FROM {t} GROUP BY ALL)"""


@query("D13_reliability", with_views("calib") + ECE.replace("{k}", "provider").replace("{t}", "calib") + " SELECT provider, bin, n, round(ac,6) AS accuracy, round(co,6) AS confidence FROM rb")
def _(v):
    return op.reliability(v.calib, ["provider"]).withColumn("accuracy", r6("accuracy")).withColumn("confidence", r6("confidence"))


@query("D13_ece", with_views("calib") + ECE.replace("{k}", "provider").replace("{t}", "calib") + " SELECT provider, samples, round(coalesce(gap,0)/samples,6) AS ece, round(brier,6) AS brier, round(sharpness,6) AS sharpness, round(bias,6) AS bias FROM em LEFT JOIN eg USING (provider)")
def _(v):
    d = op.ece(v.calib, ["provider"])
    return d.select("provider", "samples", *[r6(c).alias(c) for c in ("ece", "brier", "sharpness", "bias")])


@query("E17_rolling_ece", with_views("calib") + """, cl AS (SELECT 'all' AS provider, doc_id, raw, label FROM calib), o AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY provider) AS t FROM cl), ws AS (SELECT provider, raw, label, unnest(range(greatest(0,CAST(ceil((i-50)/1e1) AS BIGINT)), least((i-1)//10,(t-50)//10)+1)) AS win FROM o WHERE t>=50)"""
       + ECE.replace("{k}", "provider, win").replace("{t}", "ws") + " SELECT provider, win AS \"window\", samples, round(coalesce(gap,0)/samples,6) AS ece FROM em LEFT JOIN eg USING (provider,win)")
def _(v):
    d = v.calib.withColumn("provider", F.lit("all"))
    return op.rolling_ece(d, ["provider"], ["doc_id"], F.floor(F.col("doc_id") / 10_000)).withColumn("ece", r6("ece"))


@query("H17_calibration_alerts", with_views("calib") + """, cl AS (SELECT concat('g',provider[4:4]) AS provider, doc_id, raw, label FROM calib QUALIFY row_number() OVER (PARTITION BY concat('g',provider[4:4]) ORDER BY doc_id DESC)<=1000)""" + ECE.replace("{k}", "provider").replace("{t}", "cl")
       + " SELECT provider, samples, round(coalesce(gap,0)/samples,6) AS ece, round(bias,6) AS bias, CASE WHEN samples>=50 AND gap/samples>15e-2 THEN CASE WHEN gap/samples>2e-1 THEN 'high' ELSE 'medium' END END AS ece_alert, samples>=50 AND abs(bias)>1e-1 AS bias_alert FROM em LEFT JOIN eg USING (provider)")
def _(v):
    d = v.calib.withColumn("provider", F.concat(F.lit("g"), F.substring("provider", 4, 1)))
    return op.calibration_alerts(d, [F.desc("doc_id")]).withColumn("ece", r6("ece")).withColumn("bias", r6("bias"))


def grouped_samples(v):
    """Languages stand for providers: each has dozens of labelled documents or more."""
    return v.calib.join(v.table("documents").select("doc_id", "lang"), "doc_id").drop("provider").withColumnRenamed("lang", "provider")


@query("H15_fit_calibrators")
def _(v):
    return op.fit_calibrators(grouped_samples(v))


@query("H15_apply_calibrators")
def _(v):
    s = grouped_samples(v)
    return op.apply_calibrators(s, op.fit_calibrators(s)).withColumn("calibrated", r6("calibrated"))


@query("H16_calibration_labels", HS + r""", s AS (SELECT session_id, id, engine, confidence, start, "end", list_distinct(string_split_regex(lower(trim(text)),'\s+')) AS ws FROM hs), g AS (SELECT s.session_id, s.id, s.engine, list_distinct(list(lower(trim(word)))) AS gs FROM s JOIN word w ON w.session_id=s.session_id AND w.start_ms<s."end" AND w.end_ms>s.start GROUP BY 1,2,3),
 j AS (SELECT s.*, len(list_intersect(ws,coalesce(gs,[])))/len(list_distinct(list_concat(ws,coalesce(gs,[])))) AS jac FROM s LEFT JOIN g USING (session_id,id,engine)) SELECT session_id, id, engine, round(confidence,6) AS confidence, round(jac,6) AS jaccard, CASE WHEN round(jac,9)>=8e-1 THEN 1 ELSE 0 END AS label FROM j""")
def _(v):
    gold = v.word.select("session_id", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"), "word")
    d = op.calibration_labels(hs(v), gold, WIDTH)
    return d.withColumn("confidence", r6("confidence")).withColumn("jaccard", r6("jaccard"))


LIMITS = [("click", None, 100.0), ("view", 10.0, None), ("error", None, 20.0)]


@query("D19_ci_report", with_views("metric") + """, m AS (SELECT name, count(*) AS n, avg(value) AS avg, min(value) AS min, max(value) AS max, arg_max(value,(ts,event_id)) AS last FROM metric GROUP BY 1) SELECT name, n, round(avg,6) AS avg, min, max, last, CASE name WHEN 'click' THEN last<=100 WHEN 'view' THEN last>=10 WHEN 'error' THEN last<=20 ELSE true END AS passed FROM m""")
def _(v):
    gates = v.spark.createDataFrame(LIMITS, "name string, low double, high double")
    return op.ci_report(points(v), gates).withColumn("avg", r6("avg"))


QS = """WITH rs AS (SELECT concat('t',l_suppkey) AS test_id, l_shipdate AS ts, l_orderkey*10+l_linenumber AS q, l_partkey AS pk, l_discount*4 AS der, l_tax*3 AS wer, l_quantity/5e1 AS confidence FROM lineitem), la AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY ts DESC, q*1000000+pk DESC)=1), c AS (SELECT *, round(4e-1*(1-der)+4e-1*(1-wer)+2e-1*confidence,9) AS co FROM la)"""


@query("D20_quality_summary", QS + """ SELECT count(*) AS tests, round(avg(der),6) AS avg_der, round(avg(wer),6) AS avg_wer, round(avg(confidence),6) AS avg_confidence, round(avg(co),6) AS composite, arg_min(test_id,(-co,test_id)) AS best, arg_min(test_id,(co,test_id)) AS worst, count(*) FILTER (der<=15e-2) AS excellent, count(*) FILTER (der>15e-2 AND der<=25e-2) AS good, count(*) FILTER (der>25e-2 AND der<=35e-2) AS fair, count(*) FILTER (der>35e-2) AS poor FROM c""")
def _(v):
    r = v.table("lineitem").select(F.concat(F.lit("t"), "l_suppkey").alias("test_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("seq"),
                                   (F.col("l_discount") * 4).alias("der"), (F.col("l_tax") * 3).alias("wer"), (F.col("l_quantity") / 50.0).alias("confidence"))
    d = op.quality_summary(r)
    return d.select("tests", "best", "worst", "excellent", "good", "fair", "poor", *[r6(c).alias(c) for c in ("avg_der", "avg_wer", "avg_confidence", "composite")])
