"""Quality, disagreement, work-list and review queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from chorale.functions import entities as ent
from chorale.functions.numeric import r6
from chorale.operators import quality as op, turns as tn
from chorale.plans.linguistic import _in
from chorale.plans.registry import query
from chorale.plans.turns import HS, MS, SG, VOTERS_SQL, WIDTH, hs, sg, voters
from chorale.views import with_views

LV = dict(zip(["f", "d", "a", "l", "r", "o", "seg", "w"], op.LEVELS["review"]))


def _sev(x, m):
    return f"CASE WHEN {x}/{m!r}::DOUBLE<5e-1 THEN 'critical' WHEN {x}/{m!r}::DOUBLE<7e-1 THEN 'high' WHEN {x}/{m!r}::DOUBLE<85e-2 THEN 'medium' ELSE 'low' END"


def quality_inputs(v):
    c = v.cand
    segs = c.select("session_id", F.col("supplier_id").alias("id"), F.col("d").alias("confidence"), F.col("o").alias("alignment"),
                    (F.col("supplier_id") % 9 == 0).cast("bigint").alias("conflicts"))
    scores = c.groupBy("session_id").agg(F.avg("d").alias("d"), F.avg("a").alias("a"), F.avg("l").alias("l"), F.avg("r").alias("r"), F.avg("o").alias("o"))
    scores = scores.select("session_id", *[F.round(x, 9).alias(x) for x in "dalro"]).withColumn(
        "final", F.round(0.28 * F.col("d") + 0.32 * F.col("a") + 0.18 * F.col("l") + 0.12 * F.col("r") + 0.10 * F.col("o"), 9))
    return segs, scores


QIN = with_views("cand") + f""", sgm AS (SELECT session_id, supplier_id AS id, d AS confidence, o AS alignment, CAST(supplier_id%9=0 AS BIGINT) AS conflicts FROM cand),
 sc0 AS (SELECT session_id, round(avg(d),9) AS d, round(avg(a),9) AS a, round(avg(l),9) AS l, round(avg(r),9) AS r, round(avg(o),9) AS o FROM cand GROUP BY 1), scr AS (SELECT *, round(28e-2*d+32e-2*a+18e-2*l+12e-2*r+1e-1*o,9) AS final FROM sc0),
 sq AS (SELECT *, avg(confidence) OVER w AS mean, coalesce(stddev_samp(confidence) OVER w,0) AS std FROM sgm WINDOW w AS (PARTITION BY session_id)),
 iss AS (SELECT session_id, id, 'low_confidence' AS kind, {_sev('confidence', LV['seg'])} AS severity, confidence AS score FROM sq WHERE confidence<{LV['seg']}::DOUBLE UNION ALL SELECT session_id, id, 'speaker_confusion', 'high', confidence FROM sq WHERE conflicts>0
  UNION ALL SELECT session_id, id, 'alignment_issue','medium', alignment FROM sq WHERE alignment<6e-1 UNION ALL SELECT session_id, id, 'transcription_error','medium', confidence FROM sq WHERE NOT confidence<{LV['seg']}::DOUBLE AND round(confidence-(mean-{LV['w']}::DOUBLE*std),9)<0
  """ + " ".join(f"UNION ALL SELECT session_id, -1, '{k}', {_sev(x, LV[x])}, {x} FROM scr WHERE {x}<{LV[x]}::DOUBLE" for x, k in op.DIMENSION_ISSUES.items()) + ")"


@query("H18_quality_issues", QIN + " SELECT session_id, CAST(id AS BIGINT) AS id, kind, severity, round(score,6) AS score FROM iss")
def _(v):
    return op.quality_issues(*quality_inputs(v)).withColumn("score", r6("score"))


@query("H18_assess_quality", QIN + f""", m AS (SELECT session_id, count(*) AS segments, avg(confidence) AS mean, count(*) FILTER (confidence<{LV['seg']}::DOUBLE) AS flagged FROM sgm GROUP BY 1),
 i AS (SELECT session_id, count(*) AS issues, count(*) FILTER (severity='critical') AS critical, count(*) FILTER (severity='high') AS high, count(*) FILTER (severity='medium') AS medium, count(*) FILTER (severity='low') AS low FROM iss GROUP BY 1),
 q AS (SELECT m.*, scr.*, least(1,greatest(0,7e-1*final+3e-1*mean)) AS quality FROM m JOIN scr USING (session_id))
 SELECT q.session_id, segments, flagged, round(mean,6) AS mean, round(quality,6) AS quality, final>={LV['f']}::DOUBLE AND mean>={LV['seg']}::DOUBLE AND d>={LV['d']}::DOUBLE AND a>={LV['a']}::DOUBLE AND l>={LV['l']}::DOUBLE AS passes,
 CASE WHEN round(quality,9)>=85e-2 THEN 'premium' WHEN round(quality,9)>=75e-2 THEN 'final' WHEN round(quality,9)>=6e-1 THEN 'review' ELSE 'draft' END AS grade, coalesce(issues,0) AS issues, coalesce(critical,0) AS critical, coalesce(high,0) AS high, coalesce(medium,0) AS medium, coalesce(low,0) AS low FROM q LEFT JOIN i ON i.session_id=q.session_id""")
def _(v):
    d = op.assess_quality(*quality_inputs(v))
    return d.withColumn("mean", r6("mean")).withColumn("quality", r6("quality"))


@query("F11_repair_plan", QIN + f""", al AS (SELECT session_id, CASE WHEN supplier_id%2=0 THEN supplier_id ELSE -supplier_id END AS id, max(a) AS bc, max(l) AS bs FROM cand GROUP BY 1,2), p AS (SELECT iss.session_id, iss.id, kind, severity,
 CASE kind WHEN 'low_confidence' THEN 'alternative_candidate' WHEN 'speaker_confusion' THEN 'speaker_reassignment' WHEN 'alignment_issue' THEN 'boundary_adjustment' WHEN 'transcription_error' THEN 'text_correction' ELSE 'manual_review' END AS repair_type,
 CASE WHEN severity='critical' THEN 3 WHEN severity='high' THEN 2 WHEN severity='medium' AND bs>7e-1 THEN 1 END AS priority, round(CASE WHEN bc IS NULL THEN 1e-1 ELSE greatest(0,least(1,bc-score)) END,9) AS im FROM iss LEFT JOIN al ON al.session_id=iss.session_id AND al.id=iss.id)
 SELECT session_id, CAST(id AS BIGINT) AS id, kind, severity, repair_type, CAST(priority AS INTEGER) AS priority, round(im,6) AS improvement FROM p WHERE priority IS NOT NULL""")
def _(v):
    known = F.when(F.col("supplier_id") % 2 == 0, F.col("supplier_id")).otherwise(-F.col("supplier_id"))  # half of the alternatives are for no issue
    alt = v.cand.select("session_id", known.alias("id"), F.col("a").alias("confidence"), F.col("l").alias("score"))
    return op.repair_plan(op.quality_issues(*quality_inputs(v)), alt).drop("place").withColumn("improvement", r6("improvement"))


def repaired(v):
    c = v.hyp.groupBy("session_id", "turn", "engine").agg(F.sum(F.round(F.col("confidence") * 100).cast("bigint")).alias("s"), F.count("*").alias("n"))
    w = c.select("session_id", "turn", "engine", (F.col("turn") * 3 + F.col("engine")).alias("id"), (F.col("s") / F.col("n") / 100.0).alias("confidence"))
    segs = w.select("session_id", "id", "confidence", F.concat(F.lit("t"), "id").alias("text"))
    other = w.select("session_id", "turn", F.col("engine").alias("o_engine"), F.col("confidence").alias("o_confidence"))
    best = w.join(other, ["session_id", "turn"]).where("engine <> o_engine").groupBy("session_id", "turn", "id").agg(F.max("o_confidence").alias("new_confidence"))
    fix = F.when(F.col("turn") % 2 == 0, F.col("id")).otherwise(-1 - F.col("id"))  # a fix for every other turn; the rest is for no segment
    best = best.select("session_id", fix.alias("id"), F.concat(F.lit("n"), "id").alias("new_text"), (F.col("new_confidence") + F.col("turn") / 50.0).alias("new_confidence"))
    return op.apply_repairs(segs, best)


REP = with_views("hyp") + """, w AS (SELECT session_id, turn, engine, turn*3+engine AS id, CAST(sum(CAST(round(confidence*100) AS BIGINT)) AS BIGINT)/count(*)/1e2 AS confidence FROM hyp GROUP BY ALL), b AS (SELECT w.session_id, w.id, concat('n',w.id) AS nt, max(x.confidence)+w.turn/5e1 AS nc FROM w JOIN w x ON x.session_id=w.session_id AND x.turn=w.turn AND x.engine<>w.engine WHERE w.turn%2=0 GROUP BY w.session_id, w.id, w.turn),
 rp AS (SELECT w.session_id, w.id, coalesce(nt,concat('t',w.id)) AS text, confidence AS old_confidence, coalesce(nc,confidence) AS confidence, nc IS NOT NULL AS repaired FROM w LEFT JOIN b ON b.session_id=w.session_id AND b.id=w.id)"""


@query("H19_apply_repairs", REP + " SELECT * REPLACE (round(old_confidence,6) AS old_confidence, round(confidence,6) AS confidence) FROM rp")
def _(v):
    return repaired(v).withColumn("old_confidence", r6("old_confidence")).withColumn("confidence", r6("confidence"))


@query("H19_repair_report", REP + """, g AS (SELECT *, greatest(0,least(1,confidence-old_confidence)) AS gn FROM rp), m AS (SELECT session_id, count(*) AS segments, count(*) FILTER (repaired) AS rp, count(*) FILTER (repaired AND round(gn,9)>5e-2) AS successful, avg(gn) FILTER (repaired AND round(gn,9)>5e-2) AS ai, avg(confidence) AS mc FROM g GROUP BY 1)
 SELECT session_id, segments, rp AS repaired, successful, round(coalesce(ai,0),6) AS average_improvement, round(successful/greatest(rp,1),6) AS success_rate, round(mc,6) AS mean_confidence FROM m""")
def _(v):
    d = op.repair_report(repaired(v))
    return d.select("session_id", "segments", "repaired", "successful", *[r6(c).alias(c) for c in ("average_improvement", "success_rate", "mean_confidence")])


def spread_conf(v):
    return hs(v).select("session_id", "id", "start", "end", F.when(F.col("turn") % 3 == 0, F.concat_ws(" ", F.lit("same"), F.col("turn"))).otherwise(F.col("text")).alias("text"),
                        (0.3 + (F.col("id") * 7 + F.col("session_id")) % 6 / 10.0).alias("confidence"))


SPANS = HS + r""", sp0 AS (SELECT session_id, id, start, "end", CASE WHEN turn%3=0 THEN concat_ws(' ','same',turn) ELSE text END AS text, 3e-1+((id*7+session_id)%6)/1e1 AS confidence FROM hs),
 sp1 AS (SELECT *, max("end") OVER (PARTITION BY session_id ORDER BY start,id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp0), sp2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start>reach+500 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start,id) AS grp FROM sp1),
 bs AS (SELECT session_id, grp, count(*) AS n, min(start) AS start, max("end") AS "end", count(DISTINCT text) AS texts, round(max(confidence)-min(confidence),9) AS gap FROM sp2 GROUP BY 1,2 HAVING count(*)>1),
 wx AS (SELECT session_id, grp, id, string_split_regex(trim(lower(text)),'\s+') AS ws FROM sp2), wd AS (SELECT session_id, grp, id, unnest(range(len(ws))) AS p, ws FROM wx), wk AS (SELECT session_id, grp, p, ws[p+1] AS w FROM wd),
 ct AS (SELECT session_id, grp, w, count(*) AS c FROM wk GROUP BY ALL), en AS (SELECT session_id, grp, log2(sum(c))-sum(c*log2(c))/sum(c) AS entropy FROM ct GROUP BY 1,2),
 pp AS (SELECT session_id, grp, p, count(DISTINCT w) AS k, count(*) AS held FROM wk GROUP BY ALL), di AS (SELECT session_id, grp, avg(CASE WHEN k>1 OR held<n THEN 1e0 ELSE 0e0 END) AS dis FROM pp JOIN bs USING (session_id,grp) GROUP BY 1,2),
 al AS (SELECT *, round(least(1,(texts-1)*3e-1+gap*4e-1+dis*3e-1),9) AS cross_score FROM bs JOIN en USING (session_id,grp) JOIN di USING (session_id,grp) WHERE "end"-start>=2000),
 sp AS (SELECT session_id, start, "end", gap, 'disagreement' AS method, cross_score AS score, 0e0 AS e FROM al WHERE texts>1 AND cross_score>=6e-1 AND gap>=3e-1 UNION ALL SELECT session_id, start, "end", gap, 'entropy', least(1,entropy/5e0), entropy FROM al WHERE entropy>=25e-1
  UNION ALL SELECT session_id, start, "end", gap, 'confidence_gap', least(1,gap/5e-1), 0e0 FROM al WHERE gap>=3e-1),
 m1 AS (SELECT *, max("end") OVER (PARTITION BY session_id ORDER BY start,method ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp), m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start>reach+500 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start,method) AS isl FROM m1),
 mg AS (SELECT session_id, min(start) AS start, max("end") AS "end", max(score) AS score, max(e) AS entropy, max(gap) AS gap, array_to_string(list_sort(list_distinct(list(method))),',') AS methods FROM m2 GROUP BY session_id, isl),
 us AS (SELECT * FROM mg WHERE "end"-start BETWEEN 2000 AND {x} AND round(score,9)>=6e-1 AND ((contains(methods,'entropy') AND entropy>=25e-1) OR (contains(methods,'confidence_gap') AND gap>=3e-1) OR contains(methods,'disagreement')))"""


def spans(v):
    return op.uncertain_spans(spread_conf(v), MS, WIDTH, span=(2.0, 300.0))


@query("H20_uncertain_spans", SPANS.replace("{x}", "300000") + " SELECT * REPLACE (round(score,6) AS score, round(entropy,6) AS entropy, round(gap,6) AS gap) FROM us")
def _(v):
    return spans(v).select("session_id", "start", "end", "methods", *[r6(c).alias(c) for c in ("score", "entropy", "gap")])


@query("F9_rank_spans", SPANS.replace("{x}", "300000") + """, p AS (SELECT *, round(score*4e-1+gap*3e-1+entropy/5e0*2e-1+least(("end"-start)/1e3/1e1,1)*1e-1,9) AS pr FROM us)
 SELECT session_id, start, "end", round(pr,6) AS priority, CAST(row_number() OVER (PARTITION BY session_id ORDER BY pr DESC, start) AS INTEGER) AS rank FROM p QUALIFY rank<=10""")
def _(v):
    return op.rank_spans(spans(v), MS).select("session_id", "start", "end", r6("priority").alias("priority"), "rank")


@query("H21_agreement_parts", VOTERS_SQL + r""", vw AS (SELECT *, list_distinct(string_split_regex(lower(trim(text)),'\s+')) AS ws, len(string_split_regex(trim(text),'\s+')) AS n FROM vot),
 lx AS (SELECT a.session_id, a.i_start, a.i_end, avg(len(list_intersect(a.ws,b.ws))/len(list_distinct(list_concat(a.ws,b.ws)))) AS lexical FROM vw a JOIN vw b ON a.session_id=b.session_id AND a.i_start=b.i_start AND a.i_end=b.i_end AND a.candidate_id<b.candidate_id GROUP BY ALL),
 mm AS (SELECT session_id, i_start, i_end, count(*) AS voters, greatest(0,1-stddev_pop(n)/greatest(avg(n),1)) AS length, 1-stddev_pop(confidence) AS conf FROM vw GROUP BY ALL HAVING count(*)>=2)
 SELECT session_id, i_start, i_end, voters, round(lexical,6) AS lexical, round(length,6) AS length, round(conf,6) AS conf FROM mm JOIN lx USING (session_id,i_start,i_end)""")
def _(v):
    d = op.segment_agreement(voters(v), MS)
    return d.select("session_id", "i_start", "i_end", "voters", *[r6(c).alias(c) for c in ("lexical", "length", "conf")])


@query("H21_segment_agreement")
def _(v):
    d = op.segment_agreement(voters(v), MS)
    return d.select("session_id", "i_start", "i_end", r6("edit").alias("edit"), r6("agreement").alias("agreement"), "needs_work", "priority", "consensus")


@query("H22_entity_agreement")
def _(v):
    d = v.norm.select(F.col("doc_id"), "text").withColumn("provider", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    d = d.withColumn("text", F.when(F.col("provider") == 1, F.regexp_replace("text", "7", "1")).otherwise(F.col("text")))
    spans_ = ent.entity_spans(d)
    e = spans_.select(F.col("doc_id").alias("session_id"), F.lit(0).alias("segment"), F.concat(F.lit("p"), "provider").alias("provider"), "entity_type", "entity",
                      "start_char", "end_char", (0.75 + F.col("provider") / 10.0).alias("confidence"))
    d = op.entity_agreement(e)
    return d.withColumn("agreement", r6("agreement")).withColumn("confidence", r6("confidence"))


WORK = SG + """, wl AS (SELECT session_id, id, start, "end", confidence, greatest(1,CAST(floor(round((1-confidence)*7,9)) AS BIGINT)+1) AS p0 FROM sg WHERE round(confidence,9)<65e-2),
 wf AS (SELECT session_id, id, start, "end", confidence, CASE WHEN "end"-start>10000 THEN least(10,p0+1) WHEN "end"-start<2000 THEN greatest(1,p0-1) ELSE p0 END AS priority, 'automatic' AS source FROM wl UNION ALL SELECT session_id, id, start, "end", confidence, 10, 'manual' FROM sg WHERE id%5=4)"""


def work(v):
    manual = sg(v).where("id % 5 = 4").select("session_id", "id", "start", "end", "confidence", F.lit(10).cast("bigint").alias("priority"), F.lit("manual").alias("source"))
    return op.build_worklist(sg(v), MS, manual=manual)


@query("F8_build_worklist", WORK + " SELECT session_id, id, start, \"end\", round(confidence,6) AS confidence, priority, source FROM wf")
def _(v):
    return work(v).withColumn("confidence", r6("confidence"))


@query("F8_next_work", WORK + " SELECT session_id, id, priority, source, CAST(row_number() OVER (PARTITION BY session_id ORDER BY priority DESC, confidence, id, source) AS INTEGER) AS place FROM wf QUALIFY place<=3")
def _(v):
    return op.next_work(work(v), 3).select("session_id", "id", "priority", "source", "place")


@query("D17_worklist_summary", WORK + """, x AS (SELECT *, CASE WHEN id%2=0 THEN confidence+(id%3)*4e-2 END AS nc FROM wf) SELECT session_id, count(*) AS flagged, count(nc) AS processed, count(*) FILTER (round(nc-confidence,9)>5e-2) AS improved, round(coalesce(sum(nc-confidence),0)/greatest(count(nc),1),6) AS average_improvement, count(*) FILTER (nc IS NULL) AS pending FROM x GROUP BY 1""")
def _(v):
    d = work(v).withColumn("new_confidence", F.when(F.col("id") % 2 == 0, F.col("confidence") + (F.col("id") % 3) * 0.04))
    return op.worklist_summary(d).withColumn("average_improvement", r6("average_improvement"))


@query("F13_apply_budget", SG + """, c AS (SELECT session_id, id, ("end"-start)/1e3*6e-3 AS cost, sum(("end"-start)/1e3*6e-3) OVER (PARTITION BY session_id ORDER BY id) AS spent, row_number() OVER (PARTITION BY session_id ORDER BY id) AS place FROM sg) SELECT session_id, id, round(cost,6) AS cost, round(spent,6) AS spent, place, round(spent,9)<=5e-1 AND place<=20 AS taken FROM c""")
def _(v):
    s = sg(v).withColumn("cost", (F.col("end") - F.col("start")) / 1000.0 * 0.006)
    d = op.apply_budget(s, ["id"], F.floor(F.col("id") / 1000), 0.5)
    return d.select("session_id", "id", r6("cost").alias("cost"), r6("spent").alias("spent"), "place", "taken")


@query("D22_stem_gates", """WITH st AS (SELECT l_orderkey AS session_id, l_quantity AS snr, l_discount*2e0 AS leakage, l_tax*1e1 AS artifact FROM lineitem), m AS (SELECT session_id, count(*) AS n, avg(snr) AS snr, avg(artifact) AS artifact, (list_sort(list(leakage)))[count(*)//2+1] AS leakage FROM st GROUP BY 1),
 r AS (SELECT *, CASE WHEN round(snr,9)<12 THEN 'avg_snr_too_low' WHEN leakage>12e-2 THEN 'median_leakage_too_high' WHEN round(artifact,9)>5e-1 THEN 'avg_artifacts_too_high' ELSE 'quality_gates_passed' END AS reason FROM m)
 SELECT session_id, n, round(snr,6) AS snr, round(artifact,6) AS artifact, round(leakage,6) AS leakage, reason, reason='quality_gates_passed' AS passed FROM r""")
def _(v):
    s = v.table("lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_quantity").alias("snr"), (F.col("l_discount") * 2.0).alias("leakage"), (F.col("l_tax") * 10.0).alias("artifact"))
    d = op.stem_gates(s, ["session_id"])
    return d.select("session_id", "n", "reason", "passed", *[r6(c).alias(c) for c in ("snr", "artifact", "leakage")])


@query("E18_uncertainty_windows", SG + r""", w AS (SELECT *, string_split_regex(trim(text),'\s+') AS ws FROM sg), c AS (SELECT *, least(len(list_filter(ws, lambda x: length(x)>8 OR (x=upper(x) AND regexp_matches(x,'\p{Lu}')) OR regexp_matches(x,'\p{Nd}')))/greatest(len(ws),1)*3e-1,2e-1) AS cx FROM w),
 x AS (SELECT session_id, id, speaker, start, "end", confidence, cx, unnest(range(greatest(CAST(floor((start/1e3-8)/4e0) AS BIGINT)+1,0), CAST(ceil("end"/1e3/4e0) AS BIGINT))) AS win FROM c),
 h AS (SELECT a.session_id, a.win, a.id, count(*) AS ch FROM x a JOIN x b ON a.session_id=b.session_id AND a.win=b.win AND a.speaker<>b.speaker AND abs(b.start-a."end")<2000 GROUP BY ALL)
 SELECT x.session_id, x.win AS "window", count(*) AS segments, round(least(sum((1-confidence)*4e-1+least(coalesce(ch,0)*2e-1,3e-1)+cx),1),6) AS uncertainty FROM x LEFT JOIN h ON h.session_id=x.session_id AND h.win=x.win AND h.id=x.id GROUP BY 1,2""")
def _(v):
    return op.uncertainty_windows(sg(v), MS).select("session_id", "window", "segments", r6("uncertainty").alias("uncertainty"))


@query("F10_select_hotspots")
def _(v):
    return op.select_hotspots(sg(v), MS)


EDITS = SG + r""", ed AS (SELECT session_id, id AS edit_id, text AS original_text, concat('spk',id) AS ns, concat('edited ',id) AS nt FROM sg), tk AS (SELECT session_id, edit_id, list_distinct(string_split_regex(lower(trim(original_text)),'\s+')) AS ws, ns, nt FROM ed),
 st AS (SELECT *, list_distinct(string_split_regex(lower(trim(text)),'\s+')) AS ws FROM sg), hit AS (SELECT st.session_id, st.id, edit_id, ns, nt FROM st JOIN tk ON st.session_id=tk.session_id WHERE len(list_intersect(st.ws,tk.ws))>=least(3,len(tk.ws)//2)),
 la AS (SELECT session_id, id, arg_max(ns,edit_id) AS ns, arg_max(nt,edit_id) AS nt, count(*) AS edits FROM hit GROUP BY 1,2), nm AS (SELECT * FROM (VALUES ('user','Guest'),('spk1','Anna')) t(speaker,name))"""


@query("H51_apply_edits", EDITS + """, r AS (SELECT sg.session_id, sg.id, coalesce(ns,speaker) AS speaker, coalesce(nt,text) AS text, coalesce(edits,0) AS edits FROM sg LEFT JOIN la ON la.session_id=sg.session_id AND la.id=sg.id) SELECT session_id, id, coalesce(name,r.speaker) AS speaker, text, edits FROM r LEFT JOIN nm ON nm.speaker=r.speaker""")
def _(v):
    s = sg(v)
    edits = s.select("session_id", F.col("id").alias("edit_id"), F.col("text").alias("original_text"), F.concat(F.lit("spk"), "id").alias("new_speaker"),
                                         F.concat(F.lit("edited "), "id").alias("new_text"))
    names = v.spark.createDataFrame([("user", "Guest"), ("spk1", "Anna")], "speaker string, name string")
    return op.apply_edits(s, edits, names)
