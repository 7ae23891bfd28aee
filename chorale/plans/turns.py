"""Turn, interval and word-time queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from chorale.functions.numeric import r6
from chorale.operators import turns as op
from chorale.plans.registry import query
from chorale.views import WORDS, with_views

US, MS = 1_000_000, 1_000
HOURS4 = 14_400_000_000
WIDTH = 60_000


def iv(v):
    return v.ivl.select("session_id", F.col("event_id").alias("id"), "speaker", F.col("start_us").alias("start"),
                        F.col("end_us").alias("end"), "confidence")


def sg(v):
    return v.seg.select("session_id", F.col("turn").alias("id"), "speaker", F.col("start_ms").alias("start"),
                        F.col("end_ms").alias("end"),
                        (0.5 + (F.col("turn") * 7 + F.col("session_id")) % 10 / 20.0).alias("confidence"), "text")


def hs(v):
    return v.hseg.select("session_id", (F.col("turn") * 3 + F.col("engine")).alias("id"), "turn", "engine", "speaker",
                         F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "confidence", "text")


IV = with_views("ivl") + """, iv AS (SELECT session_id, event_id AS id, speaker, start_us AS start, end_us AS "end", confidence FROM ivl)"""
SG = with_views("seg") + """, sg AS (SELECT session_id, turn AS id, speaker, start_ms AS start, end_ms AS "end",
 5e-1+((turn*7+session_id)%10)/2e1 AS confidence, text FROM seg)"""
SGW = with_views("word") + SG[len(with_views("seg")):]
HS = with_views("hseg") + """, hs AS (SELECT session_id, turn*3+engine AS id, turn, engine, speaker, start_ms AS start, end_ms AS "end", confidence, text FROM hseg)"""
PAIRS = """, ov AS (SELECT a.session_id, a.id AS id1, b.id AS id2, a.speaker AS speaker1, b.speaker AS speaker2, a.start AS start1, a."end" AS end1,
 b.start AS start2, b."end" AS end2, a.confidence AS confidence1, b.confidence AS confidence2, greatest(a.start,b.start) AS start, least(a."end",b."end") AS "end",
 least(a."end",b."end")-greatest(a.start,b.start) AS shared, least(a.confidence,b.confidence) AS confidence
 FROM iv a JOIN iv b ON a.session_id=b.session_id AND (a.start<b.start OR (a.start=b.start AND a.id<b.id)) AND b.start<a."end" AND a.start<b."end"
 WHERE least(a."end",b."end")-greatest(a.start,b.start) >= 100000)"""
NB = """, nb AS (SELECT *, lead(start) OVER w AS n_start, lead("end") OVER w AS n_end, lead(speaker) OVER w AS n_speaker, lead(id) OVER w AS n_id,
 lead("end",2) OVER w AS nn_end, lead(speaker,2) OVER w AS nn_speaker, lag("end") OVER w AS p_end FROM {t} WINDOW w AS (PARTITION BY session_id ORDER BY start, id))"""


@query("C3_find_overlaps", IV + PAIRS + """ SELECT session_id, id1, id2, start, "end", shared, round(confidence,6) AS confidence,
 round(shared/(end1-start1),6) AS ratio1, round(shared/(end2-start2),6) AS ratio2 FROM ov""")
def _(v):
    return op.find_overlaps(iv(v), US, HOURS4).select(
        "session_id", "id1", "id2", "start", "end", "shared", *[r6(c).alias(c) for c in ("confidence", "ratio1", "ratio2")])


def _near(i):
    return f"(1-least(1,abs((start{i}+end{i})/2e0-(start+shared/2e0))/((end{i}-start{i})/2e0)))"


@query("C4_overlap_probability", IV + PAIRS + f""", p AS (SELECT session_id, id1, id2, least(1,greatest(0,
  greatest(shared/(end1-start1),shared/(end2-start2))*(1-(1-(confidence1+confidence2)/2)*3e-1)*least(1,shared/1e6/5e-1)
  *CASE WHEN speaker1<>speaker2 THEN 1e0 ELSE 7e-1 END*greatest(5e-1,least(1,1-2e-1+2e-1*(({_near(1)}+{_near(2)})/2))))) AS p FROM ov)
 SELECT session_id, id1, id2, round(p,6) AS probability, round(p,9) >= 25e-2 AS separate FROM p""")
def _(v):
    d = op.overlap_probability(op.find_overlaps(iv(v), US, HOURS4), US)
    return d.select("session_id", "id1", "id2", r6("probability").alias("probability"),
                    (F.round("probability", 9) >= 0.25).alias("separate"))


@query("C5_cross_stem_overlaps", IV + """, st AS (SELECT *, id%3 AS stem, 5e-1+(id%7)/2e1 AS quality FROM iv),
 pr AS (SELECT a.session_id, a.stem AS stem1, b.stem AS stem2, a.id AS id1, b.id AS id2, greatest(a.start,b.start) AS start, least(a."end",b."end") AS "end",
  round(greatest(1e-1,least(1,((a.confidence+b.confidence)/2*4e-1+least(1,(least(a."end",b."end")-greatest(a.start,b.start))/1e6)*3e-1+(a.quality+b.quality)/2*3e-1)*CASE WHEN a.speaker<>b.speaker THEN 12e-1 ELSE 8e-1 END)),9) AS confidence,
  CASE WHEN a.confidence>b.confidence THEN a.stem ELSE b.stem END AS ds, CASE WHEN a.confidence>b.confidence THEN a.speaker ELSE b.speaker END AS dsp
  FROM st a JOIN st b ON a.session_id=b.session_id AND a.stem<b.stem AND a.start<b."end" AND b.start<a."end" WHERE least(a."end",b."end")-greatest(a.start,b.start)>=100000),
 m AS (SELECT *, max("end") OVER (PARTITION BY session_id,stem1,stem2 ORDER BY start,id1,id2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pr),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start>reach+200000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id,stem1,stem2 ORDER BY start,id1,id2) AS island FROM m)
 SELECT session_id, stem1, stem2, CAST(island AS BIGINT) AS island, min(start) AS start, max("end") AS "end", round(max(confidence),6) AS confidence, count(*) AS regions,
 arg_min(ds,(-confidence,start,id1,id2)) AS dominant_stem, arg_min(dsp,(-confidence,start,id1,id2)) AS dominant_speaker FROM i GROUP BY ALL""")
def _(v):
    d = iv(v).withColumn("stem", F.col("id") % 3).withColumn("quality", 0.5 + (F.col("id") % 7) / 20.0)
    return op.cross_stem_overlaps(d, US, HOURS4).withColumn("confidence", r6("confidence"))


def cut_turns(v):
    return sg(v).withColumn("start", F.col("start") + 100 * (F.col("id") % 4)) \
        .withColumn("end", F.col("end") - 300 * (F.col("id") % 3)).where("end > start")


@query("C1_C2_assign_speakers", SGW + """, tu AS (SELECT session_id, id AS turn_id, speaker, start+100*(id%4) AS ts, "end"-300*(id%3) AS te FROM sg WHERE "end"-300*(id%3) > start+100*(id%4)),
 w AS (SELECT session_id, turn*4294967296+pos AS word_id, start_ms AS ws, end_ms AS we FROM word),
 hit AS (SELECT w.session_id, word_id, turn_id, speaker, greatest(0,least(we,te)-greatest(ws,ts))/(we-ws) AS ratio, abs((ws+we)/2e0-(ts+te)/2e0) AS off
  FROM w JOIN tu ON w.session_id=tu.session_id AND ws<=te+150 AND we>=ts-150),
 best AS (SELECT session_id, word_id, arg_min(turn_id,(-ratio,off,turn_id)) AS turn_id, arg_min(speaker,(-ratio,off,turn_id)) AS speaker, round(least(1,max(ratio)*12e-1),6) AS confidence,
  count(*) AS candidates, count(*) FILTER (ratio>3e-1)>=2 AS conflict, false AS gap FROM hit GROUP BY 1,2),
 far AS (SELECT w.session_id, word_id, turn_id, speaker, least(abs(ws-te),abs(we-ts)) AS dist, ts FROM w JOIN tu ON w.session_id=tu.session_id WHERE (w.session_id,word_id) NOT IN (SELECT (session_id,word_id) FROM best))
 SELECT * FROM best UNION ALL SELECT session_id, word_id, arg_min(turn_id,(dist,ts,turn_id)), arg_min(speaker,(dist,ts,turn_id)), round(greatest(1e-1,1-min(dist)/1e3/2),6), 0, false, true FROM far GROUP BY 1,2""")
def _(v):
    words = v.word.select("session_id", (F.col("turn") * WORDS + F.col("pos")).alias("word_id"),
                          F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))
    return op.assign_speakers(words, cut_turns(v), MS, WIDTH).withColumn("confidence", r6("confidence"))


ELEM = """, ed AS (SELECT session_id, start AS t FROM {t} UNION SELECT session_id, "end" FROM {t}),
 el AS (SELECT * FROM (SELECT session_id, t AS start, lead(t) OVER (PARTITION BY session_id ORDER BY t) AS "end" FROM ed) WHERE "end"-start>={m})"""


@query("G1_elementary_intervals", IV + ELEM.format(t="iv", m=500000) + " SELECT * FROM el")
def _(v):
    return op.elementary_intervals(iv(v), US, HOURS4)


VOTERS_SQL = HS + ELEM.format(t="hs", m=500) + """, vo AS (SELECT el.session_id, el.start AS i_start, el."end" AS i_end, engine AS candidate_id, id, hs.start, text
  FROM el JOIN hs ON el.session_id=hs.session_id AND el.start<hs."end" AND hs.start<el."end"
  WHERE (least(el."end",hs."end")-greatest(el.start,hs.start))/greatest(hs."end"-hs.start,100e0) > 3e-1),
 wc AS (SELECT vo.i_start, vo.i_end, vo.session_id, vo.candidate_id, vo.id, sum(confidence) AS s, count(*) AS c FROM vo JOIN hyp h ON h.session_id=vo.session_id AND h.engine=vo.candidate_id
  AND h.turn*3+h.engine=vo.id AND h.start_ms>=vo.i_start AND h.end_ms<=vo.i_end GROUP BY ALL),
 vot AS (SELECT vo.session_id, i_start, i_end, candidate_id, string_agg(text,' ' ORDER BY vo.start, vo.id) AS text, coalesce(sum(s)/sum(c),5e-1) AS confidence
 FROM vo LEFT JOIN wc USING (session_id,i_start,i_end,candidate_id,id) GROUP BY ALL)"""


def voters(v):
    segs = hs(v).withColumnRenamed("engine", "candidate_id").select("session_id", "candidate_id", "id", "start", "end", "text")
    words = v.hyp.select("session_id", F.col("engine").alias("candidate_id"), (F.col("turn") * 3 + F.col("engine")).alias("id"),
                         F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"), "confidence")
    return op.collect_voters(op.elementary_intervals(hs(v), MS, WIDTH), segs, words, MS, WIDTH)


@query("C6_collect_voters", VOTERS_SQL + " SELECT * REPLACE (round(confidence,6) AS confidence) FROM vot")
def _(v):
    return voters(v).withColumn("confidence", r6("confidence"))


@query("C7_repair_candidates", HS + """, p AS (SELECT session_id, id AS issue_id, start AS p_start, "end" AS p_end FROM hs WHERE engine=1 AND round(confidence,9)<74e-2),
 c AS (SELECT p.session_id, issue_id, engine AS candidate_id, id, (least(p_end,"end")-greatest(p_start,start))/(p_end-p_start) AS ratio, confidence, 5e-1+engine*2e-1 AS final
  FROM p JOIN hs ON p.session_id=hs.session_id AND p_start<"end" AND start<p_end WHERE engine<>1),
 s AS (SELECT *, round(least(1,greatest(0,confidence+least(2e-1,ratio-5e-1)+least(1e-1,(final-5e-1)*2e-1))),9) AS score FROM c WHERE ratio>5e-1)
 SELECT session_id, issue_id, candidate_id, id, round(score,6) AS score, CAST(row_number() OVER (PARTITION BY session_id,issue_id ORDER BY score DESC,candidate_id,id) AS INTEGER) AS rank FROM s QUALIFY rank<=5""")
def _(v):
    d = hs(v)
    issues = d.where((F.col("engine") == 1) & (F.round("confidence", 9) < 0.74)).select(
        "session_id", F.col("id").alias("issue_id"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    segs = d.where("engine <> 1").select("session_id", F.col("engine").alias("candidate_id"), "id", "start", "end",
                                         "confidence", (0.5 + F.col("engine") * 0.2).alias("final"))
    return op.repair_candidates(issues, segs, MS, WIDTH).select(
        "session_id", "issue_id", "candidate_id", "id", r6("score").alias("score"), "rank")


@query("C8_attach_embeddings", with_views("emb") + """, t AS (SELECT chunk, vec_id, (vec_id%50)*2000 AS t0, (vec_id%50)*2000+2500 AS t1, embedding FROM emb),
 s AS (SELECT chunk, vec_id AS segment_id, (vec_id%50)*2000+700 AS s0, (vec_id%50)*2000+2200 AS s1 FROM emb)
 SELECT s.chunk AS session_id, segment_id, arg_min(vec_id,(-(least(s1,t1)-greatest(s0,t0)),t0,vec_id)) AS turn_id, max(least(s1,t1)-greatest(s0,t0)) AS shared,
 round(CAST(arg_min(embedding[1],(-(least(s1,t1)-greatest(s0,t0)),t0,vec_id)) AS DOUBLE),6) AS first_value FROM s JOIN t ON s.chunk=t.chunk AND least(s1,t1)-greatest(s0,t0)>100 GROUP BY 1,2""")
def _(v):
    at = (F.col("vec_id") % 50) * 2000
    turns = v.emb.select(F.col("chunk").alias("session_id"), F.col("vec_id").alias("id"), at.alias("start"), (at + 2500).alias("end"), "embedding")
    segs = v.emb.select(F.col("chunk").alias("session_id"), F.col("vec_id").alias("id"), (at + 700).alias("start"), (at + 2200).alias("end"))
    return op.attach_embeddings(segs, turns, MS, 30_000).select(
        "session_id", "segment_id", "turn_id", "shared", r6(F.col("embedding")[0].cast("double")).alias("first_value"))


@query("C12_overlap_coverage", IV + PAIRS.replace(">= 100000", "> 0") + """, hv AS (SELECT session_id, id, start+(id%5)*600000000 AS start, "end"+(id%3)*600000000 AS "end" FROM iv),
 ho AS (SELECT DISTINCT a.session_id, greatest(a.start,b.start) AS h0, least(a."end",b."end") AS h1 FROM hv a JOIN hv b ON a.session_id=b.session_id AND a.id<b.id
  AND a.start<b."end" AND b.start<a."end" WHERE a."end">a.start AND b."end">b.start),
 f AS (SELECT DISTINCT ov.session_id, id1, id2 FROM ov JOIN ho ON ov.session_id=ho.session_id AND ov.start<ho.h1 AND ho.h0<ov."end"
  WHERE (least(ov."end",h1)-greatest(ov.start,h0))/(greatest(ov."end",h1)-least(ov.start,h0)) >= 5e-1),
 a AS (SELECT session_id, count(*) AS n_overlaps, count(f.id1) AS matched FROM ov LEFT JOIN f USING (session_id,id1,id2) GROUP BY 1)
 SELECT session_id, coalesce(n_overlaps,0) AS n_overlaps, coalesce(matched,0) AS matched, round(coalesce(matched/n_overlaps,1e0),6) AS coverage FROM (SELECT DISTINCT session_id FROM iv) LEFT JOIN a USING (session_id)""")
def _(v):
    d = iv(v)
    hyp = d.withColumn("start", F.col("start") + (F.col("id") % 5) * 600_000_000) \
        .withColumn("end", F.col("end") + (F.col("id") % 3) * 600_000_000)
    return op.overlap_coverage(d, hyp, US, HOURS4).withColumnRenamed("overlaps", "n_overlaps").withColumn("coverage", r6("coverage"))


@query("E2_speaker_smoothness", IV + NB.format(t="iv") + """ SELECT session_id, count(*) AS turns, count(*) FILTER (speaker=nn_speaker AND speaker<>n_speaker AND nn_end-start<=14400000000) AS flips,
 round(CASE WHEN count(*)<3 THEN 1e0 ELSE greatest(0,1-count(*) FILTER (speaker=nn_speaker AND speaker<>n_speaker AND nn_end-start<=14400000000)/(count(*)-2e0)) END,6) AS smoothness FROM nb GROUP BY 1""")
def _(v):
    return op.speaker_smoothness(iv(v), US, HOURS4, span=14400.0).withColumn("smoothness", r6("smoothness"))


@query("E4_transition_consistency", SG + NB.format(t="sg") + """ SELECT session_id, count(*) AS turns, count(*) FILTER (n_start-"end" BETWEEN -100 AND 3000) AS good,
 round(CASE WHEN count(*)<2 THEN 1e0 ELSE count(*) FILTER (n_start-"end" BETWEEN -100 AND 3000)/(count(*)-1e0) END,6) AS consistency FROM nb GROUP BY 1""")
def _(v):
    return op.transition_consistency(sg(v), MS, WIDTH).withColumn("consistency", r6("consistency"))


@query("E10_rapid_transitions", IV + NB.format(t="iv") + """ SELECT session_id, id, n_id, speaker, n_speaker, n_start-"end" AS gap, n_start-"end"<0 AS is_overlap FROM nb
 WHERE n_start-"end"<100000 AND speaker<>n_speaker""")
def _(v):
    return op.rapid_transitions(iv(v), US, HOURS4)


@query("E12_stability_metrics", IV + NB.format(t="iv") + """, a AS (SELECT session_id, count(*) AS turns, count(*) FILTER (speaker<>n_speaker) AS transitions,
 count(*) FILTER (speaker<>n_speaker AND n_start-"end"<100000) AS rapid, count(*) FILTER (n_start-"end" BETWEEN -100000 AND 2000000) AS nat, count(*) FILTER ("end"-start>=500000) AS lasting FROM nb GROUP BY 1)
 SELECT session_id, turns, transitions, rapid, round(CASE WHEN turns<2 THEN 1e0 ELSE nat/(turns-1e0) END,6) AS preservation, round(lasting/turns,6) AS consistency,
 round(CASE WHEN turns<2 THEN 1e0 ELSE (turns-1-rapid)/(turns-1e0) END,6) AS smoothness FROM a""")
def _(v):
    d = op.stability_metrics(iv(v), US, HOURS4)
    return d.select("session_id", "turns", "transitions", "rapid", *[r6(c).alias(c) for c in ("preservation", "consistency", "smoothness")])


@query("D28_variant_quality", SG + NB.format(t="sg") + """, a AS (SELECT session_id, count(*) AS turns, count(*) FILTER (speaker<>n_speaker) AS ch, sum("end"-start)/1e3 AS dur, avg(confidence) AS confidence,
 arg_max("end",(start,id))/1e3 AS le FROM nb GROUP BY 1), b AS (SELECT session_id, turns, 1-least(ch/turns,1) AS consistency, dur/greatest(le,1) AS coverage, confidence, dur/turns AS mean_length FROM a)
 SELECT session_id, turns, round(consistency,6) AS consistency, round(coverage,6) AS coverage, round(confidence,6) AS confidence, round(mean_length,6) AS mean_length,
 round(least(1,greatest(0,consistency*3e-1+coverage*2e-1+confidence*3e-1+least(mean_length/1e1,1)*2e-1)),6) AS quality FROM b""")
def _(v):
    d = op.variant_quality(sg(v), MS, WIDTH)
    return d.select("session_id", "turns", *[r6(c).alias(c) for c in ("consistency", "coverage", "confidence", "mean_length", "quality")])


def hyp_words(v, engine=1):
    return v.hyp.where(F.col("engine") == engine).select(
        "session_id", F.col("turn").alias("segment"), "speaker", (F.col("turn") * WORDS + F.col("pos")).alias("word_id"),
        F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "word", "confidence")


HW = with_views("hyp") + """, hw AS (SELECT session_id, turn AS segment, speaker, turn*4294967296+pos AS word_id, start_ms AS start, end_ms AS "end", word, confidence FROM hyp WHERE engine=1)"""
W2S = """, a AS (SELECT *, lag("end") OVER w AS pe, lag(speaker) OVER w AS ps FROM hw WINDOW w AS (PARTITION BY session_id ORDER BY start, word_id)),
 b AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps<>speaker OR start-pe>{g} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start, word_id) AS segm FROM a)
 SELECT session_id, CAST(segm AS BIGINT) AS segment, speaker, min(start) AS start, max("end") AS "end", count(*) AS words, round(avg(confidence),6) AS confidence, string_agg(word,' ' ORDER BY start, word_id) AS text FROM b GROUP BY ALL"""


@query("E5_words_to_segments", HW + W2S.format(g=2000))
def _(v):
    return op.words_to_segments(hyp_words(v), MS, WIDTH).withColumn("confidence", r6("confidence"))


@query("E5_words_to_segments_half_second", HW + W2S.format(g=500))
def _(v):
    return op.words_to_segments(hyp_words(v), MS, WIDTH, 0.5).withColumn("confidence", r6("confidence"))


VIO = IV + NB.format(t="iv") + """, g AS (SELECT session_id, n_id AS id, (n_start-"end")/1e6 AS gap, speaker<>n_speaker AS ch FROM nb WHERE n_id IS NOT NULL),
 vi AS (SELECT session_id, id, gap, 'overlap' AS kind, CASE WHEN gap < -1e-1 THEN 'critical' ELSE 'warning' END AS severity FROM g WHERE gap<0
  UNION ALL SELECT session_id, id, gap, 'gap', CASE WHEN gap<5 THEN 'warning' ELSE 'minor' END FROM g WHERE gap>2
  UNION ALL SELECT session_id, id, gap, 'reverse_order','critical' FROM g WHERE gap < -1e-2 UNION ALL SELECT session_id, id, gap, 'token_overlap','critical' FROM g WHERE gap < -5e-2
  UNION ALL SELECT session_id, id, gap, 'speaker_transition_gap','warning' FROM g WHERE ch AND gap>1)"""


@query("E6_boundary_violations", VIO + " SELECT * REPLACE (round(gap,6) AS gap) FROM vi")
def _(v):
    return op.boundary_violations(iv(v), US, HOURS4).withColumn("gap", r6("gap"))


@query("E6_boundary_report", VIO + """ SELECT session_id, turns, coalesce(v,0) AS violations, coalesce(c,0) AS critical, coalesce(c,0)=0 AS is_valid FROM (SELECT session_id, count(*) AS turns FROM iv GROUP BY 1)
 LEFT JOIN (SELECT session_id, count(*) AS v, count(*) FILTER (severity='critical') AS c FROM vi GROUP BY 1) USING (session_id)""")
def _(v):
    return op.boundary_report(iv(v), US, HOURS4)


@query("E7_fix_boundaries", IV + NB.format(t="iv") + """ SELECT session_id, id, speaker, CASE WHEN start<p_end THEN (start+p_end)/2e0 ELSE start::DOUBLE END AS start,
 CASE WHEN n_start<"end" THEN (n_start+"end")/2e0 ELSE "end"::DOUBLE END AS "end", coalesce(start<p_end,false) OR coalesce(n_start<"end",false) AS moved FROM nb""")
def _(v):
    return op.fix_boundaries(iv(v), HOURS4).withColumn("moved", F.coalesce("moved", F.lit(False)))


@query("E8_dedupe_words", HW.replace("end_ms AS \"end\", word", "end_ms AS \"end\", CASE WHEN pos%6 IN (2,3) THEN 'again' ELSE word END AS word") + """,
 a AS (SELECT *, lower(trim(word)) AS low FROM hw), b AS (SELECT *, lag(low) OVER w AS pl, lag("end") OVER w AS pe, lag(segment) OVER w AS pg, lead(low) OVER w AS nl, lead(start) OVER w AS ns, lead(segment) OVER w AS ng, lead(confidence) OVER w AS nc,
  lag(confidence) OVER w AS pc FROM a WINDOW w AS (PARTITION BY session_id ORDER BY start, word_id)),
 d AS (SELECT *, coalesce(low=pl AND segment=pg AND start-pe<100 AND low NOT IN ('the','a','an','and','or','but'),false) AS adj FROM b),
 e AS (SELECT *, row_number() OVER w AS rn, max(CASE WHEN NOT adj THEN rn0 END) OVER w AS r0 FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start, word_id) AS rn0 FROM d) WINDOW w AS (PARTITION BY session_id ORDER BY start, word_id)),
 c AS (SELECT *, adj AND (rn-r0)%2=1 AS dup, coalesce(lead(adj) OVER (PARTITION BY session_id ORDER BY rn),false) AND (rn-r0)%2=0 AS ndup FROM e)
 SELECT session_id, word_id, start, word, round(confidence,6) AS confidence FROM c WHERE CASE WHEN dup THEN confidence>pc WHEN ndup THEN NOT nc>confidence ELSE true END""")
def _(v):
    pos = F.col("word_id") % WORDS
    words = hyp_words(v).withColumn("word", F.when((pos % 6).isin(2, 3), "again").otherwise(F.col("word")))
    return op.dedupe_words(words, MS, WIDTH).select("session_id", "word_id", "start", "word", r6("confidence").alias("confidence"))


@query("E8_edge_duplicates", with_views("seg") + r""", p AS (SELECT session_id, turn AS id, start_ms AS start, string_split_regex(lower(trim(text)),'\s+') AS ws FROM seg),
 q AS (SELECT *, lead(id) OVER w AS n_id, lead(ws) OVER w AS nw FROM p WINDOW w AS (PARTITION BY session_id ORDER BY start, id))
 SELECT session_id, id, n_id, coalesce(len(ws)>=2 AND len(nw)>=2 AND ws[-2:]=nw[:2], false) AS duplicate FROM q WHERE n_id IS NOT NULL""")
def _(v):
    return op.edge_duplicates(sg(v), WIDTH)


SMOOTH = SG + """, o AS (SELECT session_id, min(start) AS o FROM sg GROUP BY 1),
 pt AS (SELECT session_id, unnest(range(CAST(ceil((start-o)/2e2) AS BIGINT), CAST(floor(("end"-o)/2e2) AS BIGINT)+1)) AS tick, speaker, confidence, start, id FROM sg JOIN o USING (session_id)),
 ac AS (SELECT session_id, tick, arg_min(speaker,(-confidence,start,id)) AS sp FROM pt GROUP BY 1,2),
 nn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tick) AS n, list(sp) OVER (PARTITION BY session_id ORDER BY tick ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS vt FROM ac),
 sm AS (SELECT session_id, tick, n, coalesce(list_filter(list_distinct(vt), lambda s: len(list_filter(vt, lambda q: q=s))/len(vt) >= 6e-1)[1], sp) AS speaker FROM nn),
 rl AS (SELECT *, lag(speaker) OVER w AS p, lead(tick) OVER w AS nt FROM sm WINDOW w AS (PARTITION BY session_id ORDER BY n)),
 ru AS (SELECT *, sum(CASE WHEN p IS NULL OR p<>speaker THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY n) AS run FROM rl),
 smt AS (SELECT session_id, CAST(run AS BIGINT) AS id, speaker, o+min(tick)*200 AS start, o+arg_max(coalesce(nt,tick),n)*200 AS "end", count(*) AS ticks FROM ru JOIN o USING (session_id) GROUP BY session_id, run, speaker, o)"""


@query("E9_smooth_turns", SMOOTH + " SELECT * FROM smt")
def _(v):
    return op.smooth_turns(sg(v), 200, WIDTH)


@query("E11_enforce_min_duration", IV + """, a AS (SELECT *, lag(start) OVER w AS ps, lag("end") OVER w AS pe, lag(speaker) OVER w AS psp, lag(confidence) OVER w AS pc,
  lead(start) OVER w AS ns, lead("end") OVER w AS ne, lead(speaker) OVER w AS nsp, lead(confidence) OVER w AS nc, row_number() OVER w AS rn FROM iv WINDOW w AS (PARTITION BY session_id ORDER BY start, id)),
 t AS (SELECT *, CASE WHEN "end"-start>=12000000000 THEN NULL WHEN psp=speaker THEN 'p' WHEN nsp=speaker THEN 'n' WHEN ps IS NULL AND ns IS NULL THEN NULL WHEN ps IS NULL THEN 'n' WHEN ns IS NULL THEN 'p' WHEN nc>pc THEN 'n' ELSE 'p' END AS tg FROM a),
 r AS (SELECT *, coalesce(lag(tg='n') OVER (PARTITION BY session_id ORDER BY rn), false) AS pm FROM t),
 g AS (SELECT *, rn - max(CASE WHEN NOT pm THEN rn END) OVER (PARTITION BY session_id ORDER BY rn) AS k FROM r)
 SELECT session_id, id, CASE tg WHEN 'n' THEN least(start,ns) WHEN 'p' THEN least(start,ps) ELSE start END AS start, CASE tg WHEN 'n' THEN greatest("end",ne) WHEN 'p' THEN greatest("end",pe) ELSE "end" END AS "end",
 CASE tg WHEN 'n' THEN nsp WHEN 'p' THEN psp ELSE speaker END AS speaker, round(CASE tg WHEN 'n' THEN (confidence+nc)/2 WHEN 'p' THEN (confidence+pc)/2 ELSE confidence END,6) AS confidence, tg IS NOT NULL AS merged FROM g WHERE k%2=0""")
def _(v):
    return op.enforce_min_duration(iv(v), US, HOURS4, 12_000.0).withColumn("confidence", r6("confidence"))


@query("H30_variant_agreement", HS + """, t AS (SELECT session_id, engine, sum("end"-start) AS total FROM hs GROUP BY 1,2),
 s AS (SELECT a.session_id, a.engine AS e1, b.engine AS e2, sum(least(a."end",b."end")-greatest(a.start,b.start)) AS sh FROM hs a JOIN hs b ON a.session_id=b.session_id AND a.engine<>b.engine AND a.start<b."end" AND b.start<a."end" GROUP BY ALL),
 p AS (SELECT a.session_id, a.engine AS variant, coalesce(sh,0)/1e3/greatest((a.total+b.total-coalesce(sh,0))/1e3,1e-6) AS g FROM t a JOIN t b ON a.session_id=b.session_id AND a.engine<>b.engine LEFT JOIN s ON s.session_id=a.session_id AND s.e1=a.engine AND s.e2=b.engine)
 SELECT t.session_id, t.engine AS variant, count(g) AS others, round(coalesce(avg(g),1e0),6) AS agreement FROM t LEFT JOIN p ON p.session_id=t.session_id AND p.variant=t.engine GROUP BY 1,2""")
def _(v):
    return op.variant_agreement(hs(v).withColumnRenamed("engine", "variant"), MS, WIDTH).withColumn("agreement", r6("agreement"))


@query("H40_patch_timeline", SG + """, f AS (SELECT session_id, start+("end"-start)//3 AS f0, start+2*("end"-start)//3 AS f1 FROM sg WHERE id%3=1 UNION ALL SELECT session_id, start+1000, "end"-1000 FROM sg WHERE id%3=2 AND "end"-start>4000),
 x AS (SELECT sg.*, list_sort(list({'f0':f0,'f1':f1}) FILTER (f0 IS NOT NULL)) AS cuts FROM sg LEFT JOIN f ON f.session_id=sg.session_id AND f0<"end" AND f1>start GROUP BY ALL),
 y AS (SELECT session_id, id, speaker, confidence, cuts IS NOT NULL AS trimmed, unnest(list_zip(list_concat([start], coalesce(list_transform(cuts, lambda c: c.f1),[])), list_concat(coalesce(list_transform(cuts, lambda c: c.f0),[]), ["end"]))) AS z FROM x)
 SELECT session_id, id, speaker, round(confidence,6) AS confidence, trimmed, z[1] AS start, z[2] AS "end" FROM y WHERE z[2]-z[1]>=50""")
def _(v):
    s = sg(v)
    third = F.floor((F.col("end") - F.col("start")) / 3)
    two = F.floor(2 * (F.col("end") - F.col("start")) / 3)
    frames = s.where("id % 3 = 1").select("session_id", (F.col("start") + third).alias("start"), (F.col("start") + two).alias("end")) \
        .unionByName(s.where("id % 3 = 2 and end - start > 4000").select(
            "session_id", (F.col("start") + 1000).alias("start"), (F.col("end") - 1000).alias("end")))
    return op.patch_timeline(s, frames, MS, WIDTH).withColumn("confidence", r6("confidence"))


@query("H40_clean_patches", HW.replace("WHERE engine=1", "WHERE engine=2") + """, fr AS (SELECT session_id, turn AS frame_id, start_ms+500 AS f0, end_ms-500 AS f1 FROM seg),
 p0 AS (SELECT hw.session_id, frame_id, f0, f1, word_id AS id, speaker, greatest(start,f0) AS start, least("end",f1) AS "end", word AS text, confidence FROM hw JOIN fr ON fr.session_id=hw.session_id AND fr.frame_id=hw.segment),
 p AS (SELECT *, max("end") OVER (PARTITION BY session_id, frame_id, speaker ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p0 WHERE "end"-start>=50 AND trim(text)<>''),
 q AS (SELECT *, sum(CASE WHEN reach IS NULL OR start>reach+100 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, frame_id, speaker ORDER BY start, id) AS isl FROM p),
 m AS (SELECT session_id, frame_id, speaker, min(id) AS id, min(start) AS s, max("end") AS e, sum(confidence*("end"-start))/sum("end"-start) AS confidence, count(*) AS parts, string_agg(text,' ' ORDER BY start, id) AS text FROM q GROUP BY session_id, frame_id, speaker, isl),
 z AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns FROM m WINDOW w AS (PARTITION BY session_id ORDER BY s, id)),
 y AS (SELECT session_id, frame_id, speaker, id, CASE WHEN s<pe THEN (s+pe)/2e0 ELSE s::DOUBLE END AS start, CASE WHEN ns<e THEN (ns+e)/2e0 ELSE e::DOUBLE END AS "end", round(confidence,6) AS confidence, parts, text FROM z)
 SELECT * FROM y WHERE "end">start""")
def _(v):
    frames = v.seg.select("session_id", F.col("turn").alias("frame_id"), (F.col("start_ms") + 500).alias("f0"), (F.col("end_ms") - 500).alias("f1"))
    words = hyp_words(v, 2).withColumnRenamed("segment", "frame_id").withColumnRenamed("word_id", "id").withColumnRenamed("word", "text")
    return op.clean_patches(words.join(frames, ["session_id", "frame_id"]), MS, WIDTH).withColumn("confidence", r6("confidence"))


FRAMES = """, fr AS (SELECT session_id*4+k AS session_id, start_us AS ts, confidence AS level, event_id%2=0 AS voiced FROM ivl, (VALUES (0),(1),(2),(3)) e(k)),
 fw AS (SELECT *, lag(ts) OVER w AS pt, lead(ts) OVER w AS nt, lag(level) OVER w AS pl, lead(level) OVER w AS nl, lag(voiced) OVER w AS pv, lead(voiced) OVER w AS nv FROM fr WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
 wd AS (SELECT session_id*4+event_id%4 AS session_id, event_id AS word_id, start_us+3600000000 AS start, start_us+6*3600000000 AS "end" FROM ivl)"""
CANDS = """, cs AS (SELECT w.*, f.ts AS ft, round((abs(nl-pl)+CASE WHEN pv<>nv THEN 5e-1 ELSE 0e0 END)*7e-1+(1-abs(ts-{b})/{r})*3e-1,9) AS score FROM {w} w JOIN fw f ON f.session_id=w.session_id AND ts BETWEEN {b}-{r} AND {b}+{r} AND pt>={b}-{r} AND nt<={b}+{r}),
 cr AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, word_id ORDER BY score DESC, ft) AS INTEGER) AS rank FROM cs QUALIFY rank<=5)"""
SCALE = 864_000  # the fixture's frames lie hours apart: one search second of the rule is ten days of events
CU = US * SCALE


def frames_and_words(v):
    # the words of a session lie too close for the rule; dealt to four lanes, each with all frames, they have its distances
    lanes = F.explode(F.array(*[F.col("session_id") * 4 + k for k in range(4)])).alias("session_id")
    frames = v.ivl.select(lanes, F.col("start_us").alias("ts"), F.col("confidence").alias("level"), (F.col("event_id") % 2 == 0).alias("voiced"))
    words = v.ivl.select(
        (F.col("session_id") * 4 + F.col("event_id") % 4).alias("session_id"), F.col("event_id").alias("word_id"), (F.col("start_us") + 3_600_000_000).alias("start"),
        (F.col("start_us") + 6 * 3_600_000_000).alias("end"))
    return frames, words


@query("C14_boundary_candidates", with_views("ivl") + FRAMES + CANDS.format(b="w.\"end\"", r="86400000000", w="wd") + " SELECT session_id, word_id, ft, round(score,6) AS score, rank FROM cr")
def _(v):
    frames, words = frames_and_words(v)
    return op.boundary_candidates(words.withColumn("boundary", F.col("end")), frames, CU, HOURS4 * 6).select(
        "session_id", "word_id", "ft", r6("score").alias("score"), "rank")


@query("C15_realign_boundaries", with_views("ivl") + FRAMES + """, we AS (SELECT * FROM (SELECT *, lead("end") OVER (PARTITION BY session_id ORDER BY start, word_id) AS n_end FROM wd) WHERE n_end IS NOT NULL)"""
       + CANDS.format(b="w.\"end\"", r="86400000000", w="we") + """, co AS (SELECT *, abs(ft-"end")/864e9*1e3 AS shift, round((1-score)*6e-1+abs(ft-"end")/864e9*1e3/8e1*4e-1,9) AS cost FROM cr
  WHERE abs(ft-"end")/864e9*1e3<=80 AND ft-start>=432e8 AND n_end-ft>=432e8),
 be AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY session_id, word_id ORDER BY cost, rank)=1),
 nb AS (SELECT *, lag(shift) OVER w AS p1, lag(shift,2) OVER w AS p2, lead(shift) OVER w AS n1, lead(shift,2) OVER w AS n2, count(*) OVER (PARTITION BY session_id) AS sh FROM be WINDOW w AS (PARTITION BY session_id ORDER BY start, word_id)),
 cf AS (SELECT *, CASE WHEN sh<=1 THEN 1-cost/1e1 ELSE greatest(1e-1,1-cost/1e1-(coalesce(abs(shift-p2)/3*1e-1,0)+coalesce(abs(shift-p1)/2*1e-1,0)+coalesce(abs(shift-n1)/2*1e-1,0)+coalesce(abs(shift-n2)/3*1e-1,0))) END AS c FROM nb)
 SELECT session_id, word_id, "end" AS original, ft AS adjusted, round(shift,6) AS shift, round(score,6) AS score, round(c,6) AS confidence, round(c,9)>=3e-1 AS applied FROM cf""")
def _(v):
    frames, words = frames_and_words(v)
    d = op.realign_boundaries(words, frames, CU, HOURS4 * 6)
    return d.select("session_id", "word_id", "original", "adjusted", "applied", *[r6(c).alias(c) for c in ("shift", "score", "confidence")])


@query("E23_snap_to_boundaries", HS + """, b AS (SELECT session_id, turn, CAST(round(avg(start)) AS BIGINT) AS t, 6e-1+(turn%4)/1e1 AS c FROM hs GROUP BY 1,2), g AS (SELECT session_id, t FROM b WHERE c>=7e-1)
 SELECT hs.session_id, id, speaker, coalesce((SELECT max(t) FROM g WHERE g.session_id=hs.session_id AND abs(t-start)<=300), start) AS start, coalesce((SELECT max(t) FROM g WHERE g.session_id=hs.session_id AND abs(t-"end")<=300), "end") AS "end",
 CAST(EXISTS(SELECT 1 FROM g WHERE g.session_id=hs.session_id AND abs(t-start)<=300) AS INTEGER)+CAST(EXISTS(SELECT 1 FROM g WHERE g.session_id=hs.session_id AND abs(t-"end")<=300) AS INTEGER) AS corrections FROM hs""")
def _(v):
    d = hs(v)
    b = d.groupBy("session_id", "turn").agg(F.round(F.avg("start")).cast("bigint").alias("t")).select(
        "session_id", "t", (0.6 + F.col("turn") % 4 / 10.0).alias("confidence"))
    return op.snap_to_boundaries(d, b, MS, WIDTH)
