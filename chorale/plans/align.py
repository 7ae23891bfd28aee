"""Slot, fusion and chunk queries over competing hypotheses."""
from __future__ import annotations

from pyspark.sql import functions as F

from chorale.functions import entities as ent
from chorale.functions.numeric import r6
from chorale.operators import align as op
from chorale.plans.registry import query
from chorale.plans.turns import HS, MS, WIDTH, hs
from chorale.views import WORDS, with_views

SEG = ["session_id", "turn"]
KEY_SQL = r"regexp_replace(regexp_replace(lower(trim(word)),'[^\p{L}\p{N}_\s]','','g'),'^0+([0-9]+)$','\1')"
VA = with_views("hyp") + f", va AS (SELECT session_id, turn, pos, engine, word, start_ms, end_ms, confidence, {KEY_SQL} AS key FROM hyp)"
CONS = VA + """, kk AS (SELECT session_id, turn, pos, key, count(*) AS n, sum(confidence) AS c FROM va GROUP BY ALL), kt AS (SELECT *, sum(n) OVER (PARTITION BY session_id,turn,pos) AS total FROM kk),
 ks AS (SELECT *, round(7e-1*c/n+3e-1*n/total,9) AS score FROM kt), cons AS (SELECT session_id, turn, pos, key AS word, score, CAST(total AS BIGINT) AS total FROM ks QUALIFY row_number() OVER (PARTITION BY session_id,turn,pos ORDER BY score DESC, key)=1)"""
QUAL = CONS + """, qb AS (SELECT session_id, turn, pos, count(*) AS variants, var_pop(start_ms/1e3) AS vs, var_pop(end_ms/1e3) AS ve, var_pop(confidence) AS vc, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(confidence) AS cmax, min(confidence) AS cmin, avg(confidence) AS cavg FROM va GROUP BY ALL),
 qk AS (SELECT session_id, turn, pos, max(n) AS top, count(*) AS words FROM kk GROUP BY ALL), qt AS (SELECT session_id, turn, pos, count(*) AS tied FROM (SELECT *, max(n) OVER (PARTITION BY session_id,turn,pos) AS mx FROM kk) WHERE n=mx GROUP BY ALL),
 q AS (SELECT *, CASE WHEN variants<=1 THEN 1e0 ELSE least(1,4e-1/(1+sqrt(vs+ve))+3e-1/(1+vc)+3e-1*top/variants) END AS quality FROM qb JOIN qk USING (session_id,turn,pos) JOIN qt USING (session_id,turn,pos))"""


@query("D2_slot_consensus", CONS + " SELECT * REPLACE (round(score,6) AS score) FROM cons")
def _(v):
    return op.slot_consensus(op.variants(v.hyp)).withColumn("score", r6("score"))


@query("D3_slot_quality", QUAL + " SELECT session_id, turn, pos, variants, words, top, tied, round(quality,6) AS quality FROM q")
def _(v):
    return op.slot_quality(op.variants(v.hyp)).select("session_id", "turn", "pos", "variants", "words", "top", "tied", r6("quality").alias("quality"))


@query("D4_confusion_sets", QUAL + """ SELECT session_id, turn, pos, variants, words, round(top/variants,6) AS max_agreement, round(cmax-cmin,6) AS confidence_spread, round((end_ms-start_ms)/1e3,6) AS temporal_spread, round(vc,6) AS confidence_variance FROM q WHERE words>1""")
def _(v):
    d = op.confusion_sets(op.variants(v.hyp)).drop("mean_distance")
    return d.select("session_id", "turn", "pos", "variants", "words", *[r6(c).alias(c) for c in ("max_agreement", "confidence_spread", "temporal_spread", "confidence_variance")])


@query("D4_confusion_distance")
def _(v):
    return op.confusion_sets(op.variants(v.hyp)).select("session_id", "turn", "pos", r6("mean_distance").alias("mean_distance"))


RES = """, rs AS (SELECT *, count(*) OVER (PARTITION BY session_id,turn,pos) AS words, round(7e-1*c/n+3e-1*n/total,9) AS sc FROM kt), res AS (SELECT session_id, turn, pos, key AS word, sc AS score FROM rs WHERE words>1 QUALIFY row_number() OVER (PARTITION BY session_id,turn,pos ORDER BY sc DESC, key)=1)"""


@query("D5_resolve_confusions", CONS + RES + " SELECT * REPLACE (round(score,6) AS score) FROM res")
def _(v):
    return op.resolve_confusions(op.variants(v.hyp)).withColumn("score", r6("score"))


MET = QUAL + RES + """, nm AS (SELECT session_id, turn, pos, d, count(*) AS k FROM (SELECT session_id, turn, pos, regexp_replace(unnest(regexp_extract_all(word,'([0-9]+)',1)),'^0+([0-9])','\\1') AS d FROM va) GROUP BY ALL), nv AS (SELECT session_id, turn, pos, max(k) AS nvotes FROM nm GROUP BY ALL),
 sl AS (SELECT q.*, cons.score AS co, res.score AS rsc, nvotes, (end_ms-start_ms)/1e3 AS spread FROM q JOIN cons USING (session_id,turn,pos) LEFT JOIN res USING (session_id,turn,pos) LEFT JOIN nv USING (session_id,turn,pos)),
 mm AS (SELECT {k}, count(*) AS slots, count(*) FILTER (words=1) AS perfect, count(*) FILTER (words>1) AS confusions, count(rsc) AS resolved, avg(spread) FILTER (words>1 AND spread>0) AS sp, avg(rsc-cavg) AS gain, count(*) FILTER (words>1 AND tied>1) AS osc, count(nvotes) AS num, count(*) FILTER (nvotes>=variants*6e-1) AS nok,
  sum(spread) AS covered, avg(quality) AS ql, avg(co) AS cs, max(end_ms)/1e3 AS dur FROM sl GROUP BY ALL),
 m2 AS (SELECT *, CASE WHEN dur>0 THEN covered/dur ELSE 0e0 END AS coverage, CASE WHEN confusions>0 THEN (resolved/confusions+ql+cs)/3 ELSE (ql+cs)/2 END AS effectiveness FROM mm),
 met AS (SELECT *, least(1,greatest(0,3e-1*ql+25e-2*cs+2e-1*effectiveness+15e-2*coverage+1e-1*CASE WHEN confusions>0 THEN resolved/confusions ELSE 1e0 END)) AS overall FROM m2)"""
MET_OUT = """slots, perfect, confusions, resolved, round(coalesce(sp,0),6) AS spread, round(coalesce(gain,0),6) AS gain, round(CASE WHEN confusions>0 THEN least(1,osc/confusions*8e-1) ELSE 0e0 END,6) AS oscillation, round(CASE WHEN num>0 THEN nok/num ELSE 1e0 END,6) AS numeric_consistency,
 round(coverage,6) AS coverage, round(effectiveness,6) AS effectiveness, round(overall,6) AS overall FROM met"""


@query("D6_alignment_metrics", MET.replace("{k}", "session_id") + " SELECT session_id, " + MET_OUT)
def _(v):
    d = op.alignment_metrics(op.variants(v.hyp), ["session_id"])
    return d.select("session_id", "slots", "perfect", "confusions", "resolved",
                    *[r6(c).alias(c) for c in ("spread", "gain", "oscillation", "numeric_consistency", "coverage", "effectiveness", "overall")])


ENGINES = [(0, 1.0, 0.80), (1, 1.1, 0.75), (2, 0.9, 0.70)]


def posteriors(v):
    table = v.spark.createDataFrame(ENGINES, "engine bigint, weight double, calibrated double")
    return op.token_posteriors(op.variants(v.hyp), table)


POST = VA + """, pa AS (SELECT *, ([1e0,11e-1,9e-1])[engine+1] AS w, ([8e-1,75e-2,7e-1])[engine+1] AS cal, abs(start_ms-min(start_ms) OVER (PARTITION BY session_id,turn,pos))/1e3 AS late FROM va),
 pb AS (SELECT *, CASE WHEN late<=15e-2 THEN 0e0 ELSE least((late-15e-2)/1e-1*1e-1,8e-1) END AS penalty FROM pa), pc AS (SELECT *, greatest(1-penalty,2e-1) AS coherence, CASE WHEN confidence>0 THEN (cal+confidence)/2 ELSE cal END*w*greatest(1-penalty,2e-1) AS mass FROM pb),
 po AS (SELECT *, mass/sum(mass) OVER (PARTITION BY session_id,turn,pos) AS posterior, CASE """ + " ".join(f"WHEN regexp_matches(word,'{p}') THEN '{k}'" for k, p in ent.FUSION_TYPES) + """ END AS entity_type FROM pc),
 net AS (SELECT session_id, turn, pos, arg_min(word,(-round(posterior,9),engine)) AS consensus, arg_min(posterior,(-round(posterior,9),engine)) AS consensus_posterior, -sum(CASE WHEN posterior>0 THEN posterior*log2(posterior) ELSE 0 END) AS entropy,
  count(DISTINCT engine) AS engines, (max(end_ms)-min(start_ms))/1e3 AS spread, count(*) AS tokens, count(entity_type) AS entities, sum(penalty) AS penalty FROM po GROUP BY ALL)"""


@query("D7_confusion_network", POST + " SELECT session_id, turn, pos, consensus, round(consensus_posterior,6) AS consensus_posterior, round(entropy,6) AS entropy, engines, round(spread,6) AS spread FROM net")
def _(v):
    d = op.confusion_network(posteriors(v))
    return d.select("session_id", "turn", "pos", "consensus", "engines", *[r6(c).alias(c) for c in ("consensus_posterior", "entropy", "spread")])


FM = ["entropy_avg", "entropy_max", "entropy_min", "consensus_avg", "consensus_min", "spread_avg", "spread_max", "penalty_avg", "gain"]


@query("D8_fusion_metrics", POST + """, m AS (SELECT session_id, count(*) AS slots, avg(entropy) AS entropy_avg, max(entropy) AS entropy_max, min(entropy) AS entropy_min, avg(consensus_posterior) AS consensus_avg, min(consensus_posterior) AS consensus_min, avg(spread) AS spread_avg, max(spread) AS spread_max,
 CAST(sum(entities) AS BIGINT) AS entities, sum(penalty)/sum(tokens) AS penalty_avg FROM net GROUP BY 1), b AS (SELECT session_id, count(*) AS engines, max(c) AS best FROM (SELECT session_id, engine, avg(confidence) AS c FROM po GROUP BY 1,2) GROUP BY 1)
 SELECT session_id, slots, entities, engines, """ + ", ".join(f"round({c if c != 'gain' else 'consensus_avg-best'},6) AS {c}" for c in FM) + " FROM m JOIN b USING (session_id)")
def _(v):
    p = posteriors(v)
    d = op.fusion_metrics(op.confusion_network(p), p, ["session_id"])
    return d.select("session_id", "slots", "entities", "engines", *[r6(c).alias(c) for c in FM])


@query("D8_entity_histogram", POST + " SELECT session_id, entity_type, count(*) AS n FROM po WHERE entity_type IS NOT NULL GROUP BY ALL")
def _(v):
    return op.entity_histogram(posteriors(v), ["session_id"])


@query("H1_align_words")
def _(v):
    w = v.hyp.select("session_id", F.col("engine").alias("candidate_id"), (F.col("turn") * WORDS + F.col("pos")).alias("word_id"),
                     F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return op.align_words(w, WIDTH)


@query("H1_alignment_islands", with_views("hyp") + """, a AS (SELECT session_id, engine AS candidate_id, turn*4294967296+pos AS word_id, start_ms AS start, end_ms AS "end" FROM hyp),
 b AS (SELECT *, max("end") OVER (PARTITION BY session_id ORDER BY start,candidate_id,word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a)
 SELECT session_id, candidate_id, word_id, CAST(sum(CASE WHEN reach IS NULL OR start>reach+300 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start,candidate_id,word_id) AS BIGINT) AS island FROM b""")
def _(v):
    w = v.hyp.select("session_id", F.col("engine").alias("candidate_id"), (F.col("turn") * WORDS + F.col("pos")).alias("word_id"),
                     F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return op.overlap_islands(w, ["session_id"], "start", "end", ["candidate_id", "word_id"], WIDTH, 300).select(
        "session_id", "candidate_id", "word_id", "island")


@query("H2_mbr_path")
def _(v):
    d = op.mbr_path(posteriors(v), SEG)
    return d.select("session_id", "turn", "n", F.array_join("path", " ").alias("path"), *[r6(c).alias(c) for c in ("score", "mean_score", "path_confidence")])


TIDY = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim({x}),'\s+([,.!?;:])','\1','g'),'([,.!?;:])\s*','\1 ','g'),'\s+',' ','g'))"""
_PIECES = "list_transform(regexp_extract_all(t,'([^.!?]+|[.!?]+)',1), lambda s: CASE WHEN regexp_matches(s,'^[.!?]') OR trim(s)='' THEN s ELSE concat(CASE substr(trim(s),1,1) WHEN 'ß' THEN 'SS' ELSE upper(substr(trim(s),1,1)) END,substr(trim(s),2)) END)"


@query("H3_fused_segments", VA + """, b AS (SELECT *, row_number() OVER (PARTITION BY session_id,turn,pos ORDER BY confidence DESC, engine) AS rn FROM va),
 s AS (SELECT session_id, turn, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS words, avg(confidence) AS confidence, string_agg(word,' ' ORDER BY pos) AS raw FROM b WHERE rn=1 GROUP BY 1,2),
 t AS (SELECT *, """ + TIDY.format(x="raw") + f""" AS t FROM s) SELECT session_id, turn, start_ms, end_ms, words, round(confidence,6) AS confidence, trim(array_to_string({_PIECES},'')) AS text FROM t""")
def _(v):
    va = op.variants(v.hyp)
    chosen = op.first_by(va, op.SLOT, [-F.col("confidence"), F.col("engine")], ["word", "start_ms", "end_ms", "confidence"])
    return op.fused_segments(chosen, SEG).withColumn("confidence", r6("confidence"))


@query("F5_alignment_consensus", MET.replace("{k}", "session_id") + """, ca AS (SELECT l_orderkey AS session_id, concat('c',l_linenumber) AS candidate_id, max(l_quantity/5e1) AS final FROM lineitem GROUP BY 1,2), bs AS (SELECT session_id, count(*) AS n, arg_min(candidate_id,(-final,candidate_id)) AS candidate_id, max(final) AS final FROM ca GROUP BY 1)
 SELECT session_id, CASE WHEN slots IS NOT NULL THEN concat('fusion_',n,'_candidates') ELSE candidate_id END AS winner, slots IS NOT NULL AS fused, coalesce(slots,0) AS words, round(CASE WHEN slots IS NOT NULL THEN least(1,final+effectiveness*1e-1) ELSE final END,6) AS final, round(coalesce(overall,final),6) AS confidence FROM bs LEFT JOIN met USING (session_id)""")
def _(v):
    c = v.table("lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.concat(F.lit("c"), "l_linenumber").alias("candidate_id")) \
        .agg(F.max(F.col("l_quantity") / 50.0).alias("final"))
    d = op.alignment_consensus(op.variants(v.hyp), c, ["session_id"])
    return d.withColumn("final", r6("final")).withColumn("confidence", r6("confidence"))


DEC = QUAL + """, ag AS (SELECT session_id, turn, 7e-1*count(*) FILTER (words=1)/count(*)+3e-1*avg(quality) AS agreement FROM q GROUP BY 1,2), tp AS (SELECT session_id, turn, engine, avg(quality) AS temporal FROM va JOIN q USING (session_id,turn,pos) GROUP BY ALL),
 c0 AS (SELECT session_id, turn, engine, avg(confidence) AS confidence, 1e0+engine AS pt, sum(length(word)+1)-1 AS len, min(start_ms) AS s0, max(end_ms) AS e0 FROM hyp GROUP BY ALL),
 c1 AS (SELECT *, count(*) OVER w AS n, sum(confidence) OVER w AS s1, sum(confidence*confidence) OVER w AS s2, var_pop(confidence) OVER w AS var, max(pt) OVER w AS slow, avg(len) OVER w AS al FROM c0 JOIN tp USING (session_id,turn,engine) WINDOW w AS (PARTITION BY session_id,turn)),
 c2 AS (SELECT *, round(5e-1*confidence+3e-1*temporal+1e-1*(1-pt/slow)+1e-1/(1+abs(len-al)/(al+1)),9) AS score FROM c1), c3 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY session_id,turn ORDER BY score DESC, engine)=1),
 de AS (SELECT session_id, turn, engine, score, CASE WHEN n<2 THEN 1e0 ELSE agreement END AS agreement, s2/s1/(1+var) AS confidence FROM c3 JOIN ag USING (session_id,turn))"""


def decisions(v):
    c = v.hyp.groupBy(*SEG, "engine").agg(F.avg("confidence").alias("confidence"), (F.sum(F.length("word") + 1) - 1).alias("length")) \
        .withColumn("processing_time", 1.0 + F.col("engine"))
    return op.segment_decisions(op.variants(v.hyp), c, SEG)


@query("F12_segment_decisions", DEC + """ SELECT session_id, turn, engine, round(score,6) AS score, round(agreement,6) AS agreement, round(confidence,6) AS confidence,
 CASE WHEN confidence>=92e-2 AND agreement>=85e-2 THEN 'stop_early' WHEN confidence<75e-2 THEN 'expand_maximum' ELSE 'expand_standard' END AS decision FROM de""")
def _(v):
    d = decisions(v)
    return d.select("session_id", "turn", "engine", "decision", *[r6(c).alias(c) for c in ("score", "agreement", "confidence")])


@query("F12_overall_confidence", DEC + """, sp AS (SELECT session_id, turn, max(end_ms)-min(start_ms) AS d FROM hyp GROUP BY 1,2) SELECT session_id, round(sum(d*confidence)/sum(d),6) AS confidence FROM de JOIN sp USING (session_id,turn) GROUP BY 1""")
def _(v):
    spans = v.hyp.groupBy(*SEG).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return op.duration_weighted_confidence(decisions(v), spans, SEG).withColumn("confidence", r6("confidence"))


PRIORS = [("e0", 0.95), ("e1", 0.92), ("e2", 0.90)]


def provider_segments(v):
    return hs(v).withColumn("provider", F.concat(F.lit("e"), "engine"))


REFP = HS + """, pg AS (SELECT *, start-lag("end") OVER (PARTITION BY session_id,engine ORDER BY start,id) AS gap FROM hs), pm AS (SELECT session_id, engine, count(*) AS n, count(*) FILTER (gap < -100 OR gap > 5000) AS bad FROM pg GROUP BY 1,2),
 ps AS (SELECT session_id, concat('e',engine) AS provider, n, round(([95e-2,92e-2,9e-1])[engine+1]*4e-1+least(n/1e2,1)*3e-1+(CASE WHEN n<2 THEN 1e0 ELSE 1-bad/(n-1e0) END)*3e-1,9) AS score FROM pm),
 rp AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, provider)=1)"""


def reference(v):
    priors = v.spark.createDataFrame(PRIORS, "provider string, prior double")
    return op.reference_provider(provider_segments(v), priors, MS, WIDTH)


@query("F15_reference_provider", REFP + " SELECT session_id, provider, round(score,6) AS score, n FROM rp")
def _(v):
    return reference(v).withColumn("score", r6("score"))


OFFS = REFP + """, sr AS (SELECT hs.*, concat('e',hs.engine) AS provider, rp.provider AS ref FROM hs JOIN rp USING (session_id)), rb AS (SELECT session_id, CAST(floor(start/1e2) AS BIGINT) AS b, count(*) AS rn FROM sr WHERE provider=ref GROUP BY 1,2), tb AS (SELECT session_id, provider, CAST(floor(start/1e2) AS BIGINT) AS b, count(*) AS n FROM sr WHERE provider<>ref GROUP BY 1,2,3),
 cr AS (SELECT tb.session_id, tb.provider, rb.b-tb.b AS lag, sum(n*rn) AS c FROM tb JOIN rb ON tb.session_id=rb.session_id AND rb.b-tb.b BETWEEN -20 AND 20 GROUP BY ALL), pk AS (SELECT * FROM cr QUALIFY row_number() OVER (PARTITION BY session_id,provider ORDER BY c DESC, lag)=1),
 rk AS (SELECT session_id, provider, ref, start, row_number() OVER (PARTITION BY session_id,provider ORDER BY start,id) AS rank FROM sr), hd AS (SELECT t.session_id, t.provider, avg((r.start-t.start)/1e3) AS mo FROM rk t JOIN rk r ON t.session_id=r.session_id AND r.provider=r.ref AND t.provider<>t.ref AND t.rank=r.rank WHERE t.rank<=10 GROUP BY 1,2),
 ct AS (SELECT session_id, provider, ref, count(*) AS n FROM sr GROUP BY ALL),
 ofs AS (SELECT t.session_id, t.provider, lag IS NOT NULL AND t.n>=3 AND r.n>=3 AS by_correlation, CASE WHEN lag IS NOT NULL AND t.n>=3 AND r.n>=3 THEN -lag*100/1e3 ELSE coalesce(mo,0) END AS off FROM ct t JOIN ct r ON t.session_id=r.session_id AND r.provider=r.ref AND t.provider<>t.ref LEFT JOIN pk ON pk.session_id=t.session_id AND pk.provider=t.provider LEFT JOIN hd ON hd.session_id=t.session_id AND hd.provider=t.provider)"""


@query("H45_provider_offsets", OFFS + " SELECT session_id, provider, by_correlation, round(off,6) AS \"offset\" FROM ofs")
def _(v):
    d = op.provider_offsets(provider_segments(v), reference(v), WIDTH)
    return d.withColumn("offset", r6("offset"))


@query("H45_shift_segments", OFFS + """, sh AS (SELECT sr.session_id, sr.provider, id, start, "end", CASE WHEN abs(coalesce(off,0))<1e-2 THEN 0e0 ELSE off END*1e3 AS o FROM sr LEFT JOIN ofs USING (session_id,provider))
 SELECT session_id, provider, id, round(greatest(0,start+o),6) AS start, round(greatest(greatest(0,start+o),"end"+o),6) AS "end" FROM sh""")
def _(v):
    s = provider_segments(v)
    d = op.shift_segments(s, op.provider_offsets(s, reference(v), WIDTH))
    return d.select("session_id", "provider", "id", r6("start").alias("start"), r6("end").alias("end"))


@query("E22_boundary_consensus")
def _(v):
    s = hs(v)
    first = s.groupBy("session_id", "engine").agg(F.min("start").alias("first"))
    b = s.join(first, ["session_id", "engine"]).where("start > first").select(
        "session_id", F.col("engine").alias("variant"), F.col("start").alias("t"), "confidence")
    n = s.groupBy("session_id").agg(F.countDistinct("engine").alias("n"))
    d = op.boundary_consensus(b, n, MS, WIDTH)
    return d.select("session_id", r6("t").alias("t"), r6("confidence").alias("confidence"), "support", "n")


@query("D23_text_entropy", HS + r""", w AS (SELECT session_id, turn, unnest(string_split_regex(trim(lower(text)),'\s+')) AS w FROM hs), c AS (SELECT session_id, turn, w, count(*) AS c FROM w GROUP BY ALL)
 SELECT session_id, turn, CAST(sum(c) AS BIGINT) AS tokens, round(log2(sum(c))-sum(c*log2(c))/sum(c),6) AS entropy FROM c GROUP BY 1,2""")
def _(v):
    return op.text_entropy(hs(v), SEG).withColumn("entropy", r6("entropy"))


@query("D25_hypothesis_diversity", HS + r""", b AS (SELECT session_id, turn, engine, text, confidence, len(string_split_regex(trim(text),'\s+')) AS ln, 1+engine AS sg, list_distinct(regexp_extract_all(lower(text),'[a-zA-Z]+')) AS ws FROM hs),
 s AS (SELECT *, count(*) OVER w AS n, sum(ln) OVER w AS sl, sum(sg) OVER w AS ss, sum(confidence) OVER w AS sc FROM b WINDOW w AS (PARTITION BY session_id,turn)),
 x AS (SELECT session_id, turn, engine, unnest(ws) AS w FROM b), h AS (SELECT session_id, turn, w, count(*) AS k, min(engine) AS engine FROM x GROUP BY ALL), u AS (SELECT session_id, turn, engine, count(*) AS uw FROM h WHERE k=1 GROUP BY ALL),
 r AS (SELECT s.*, coalesce(uw,0)/greatest(len(ws),1) AS us, greatest(n-1,1) AS o FROM s LEFT JOIN u USING (session_id,turn,engine))
 SELECT session_id, turn, engine, round(CASE WHEN n<2 THEN 0 ELSE least(1,abs(ln-(sl-ln)/o)/greatest((sl-ln)/o,1)) END,6) AS length_deviation, round(CASE WHEN n<2 THEN 0 ELSE us END,6) AS unique_share, round(CASE WHEN n<2 THEN 0 ELSE least(1,abs(sg-(ss-sg)/o)/greatest((ss-sg)/o,1)) END,6) AS segment_deviation, round(CASE WHEN n<2 THEN 0 ELSE abs(confidence-(sc-confidence)/o) END,6) AS confidence_deviation FROM r""")
def _(v):
    d = op.hypothesis_diversity(hs(v).withColumn("segments", 1 + F.col("engine")), SEG)
    return d.select("session_id", "turn", "engine", *[r6(c).alias(c) for c in ("length_deviation", "unique_share", "segment_deviation", "confidence_deviation")])


def stem_words(v):
    return v.hyp.select("session_id", F.col("engine").alias("stem"), (F.col("turn") * WORDS + F.col("pos")).alias("word_id"),
                        (F.col("start_ms") + 150 * (F.col("engine") % 2)).alias("start"), F.col("end_ms").alias("end"), "word", "confidence",
                        (0.9 - 0.1 * F.col("engine")).alias("attribution"),
                        F.concat(F.lit("s"), F.col("engine") % 2).alias("speaker"))


def stem_glossary(v):
    w = v.table("benchmark").select(F.explode(F.split(F.trim(F.lower("text")), r"\s+")).alias("term"))
    return w.groupBy("term").agg(F.count("*").alias("n")).select("term", (1.0 + F.least(F.col("n"), F.lit(5)) / 10.0).alias("prior"))


STEM = with_views("hyp") + r""", sw AS (SELECT session_id, engine AS stem, turn*4294967296+pos AS word_id, start_ms+150*(engine%2) AS start, end_ms AS "end", word, confidence, 9e-1-1e-1*engine AS att, lower(trim(word)) AS low, concat('s',engine%2) AS speaker FROM hyp),
 gl AS (SELECT w AS low, 1e0+least(count(*),5)/1e1 AS prior FROM (SELECT unnest(string_split_regex(trim(lower(text)),'\s+')) AS w FROM benchmark) GROUP BY 1),
 sj AS (SELECT sw.*, round(greatest(0,least(1,confidence*4e-1+coalesce(prior,1)*2e-1+att*1e-1)),9) AS joint FROM sw LEFT JOIN gl USING (low)),
 sr AS (SELECT *, max("end") OVER (PARTITION BY session_id ORDER BY start,stem,word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sj),
 sg AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach<start+100 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start,stem,word_id) AS grp FROM sr)"""


@query("H37_fuse_stems", STEM + """ SELECT session_id, CAST(grp AS BIGINT) AS grp, arg_min(word_id,(-joint,start,stem,word_id)) AS word_id, arg_min(stem,(-joint,start,stem,word_id)) AS stem, arg_min(word,(-joint,start,stem,word_id)) AS word, round(max(joint),6) AS joint, count(*) AS size FROM sg GROUP BY session_id, grp""")
def _(v):
    d = op.fuse_stems(stem_words(v), stem_glossary(v), MS, WIDTH)
    return d.select("session_id", "grp", "word_id", "stem", "word", r6("joint").alias("joint"), "size")


@query("H37_fusion_agreement")
def _(v):
    d = op.fuse_stems(stem_words(v), stem_glossary(v), MS, WIDTH)
    return d.select("session_id", "grp", r6("agreement").alias("agreement"), "competing")


@query("H38_overlap_regions", STEM + """, rg AS (SELECT session_id, turn AS region_id, start_ms+1000 AS r0, start_ms+9000 AS r1 FROM seg), n AS (SELECT rg.*, speaker, joint, start, word_id FROM rg JOIN sj ON rg.session_id=sj.session_id AND start<r1 AND "end">r0),
 p AS (SELECT session_id, region_id, r0, r1, speaker, count(*) AS n, sum(joint) AS s, min((start,word_id)) AS f FROM n GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY session_id,region_id,r0,r1 ORDER BY f) AS rk FROM p),
 a AS (SELECT session_id, region_id, r0, r1, CAST(sum(n) AS BIGINT) AS words, count(*) AS speakers, sum(s)/sum(n) AS confidence, max(CASE WHEN rk=1 THEN speaker END) AS p1, max(CASE WHEN rk=2 THEN speaker END) AS p2, max(CASE WHEN rk=1 THEN s/n END) AS m1, max(CASE WHEN rk=2 THEN s/n END) AS m2 FROM k GROUP BY 1,2,3,4)
 SELECT session_id, region_id, r0, r1, words, speakers, round(confidence,6) AS confidence, CASE WHEN round(m2,9)>round(m1,9) THEN p2 ELSE p1 END AS primary_speaker, CASE WHEN round(m2,9)>round(m1,9) THEN p1 ELSE p2 END AS secondary_speaker FROM a WHERE speakers>=2""")
def _(v):
    words = stem_words(v)
    g = stem_glossary(v).withColumnRenamed("term", "low")
    words = words.withColumn("low", F.lower(F.trim("word"))).join(g, "low", "left").withColumn("joint", F.round(F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), F.col("confidence") * 0.4 + F.coalesce("prior", F.lit(1.0)) * 0.2 + F.col("attribution") * 0.1)), 9))
    regions = v.seg.select("session_id", F.col("turn").alias("region_id"), (F.col("start_ms") + 1000).alias("r0"), (F.col("start_ms") + 9000).alias("r1"))
    d = op.overlap_regions(words.select("session_id", "speaker", "word_id", "start", "end", "joint"), regions, WIDTH)
    return d.withColumn("confidence", r6("confidence"))


@query("H39_attribute_stems")
def _(v):
    c = v.cand.groupBy("session_id").agg(F.sort_array(F.collect_set("provider")).alias("speakers"))
    stems = v.cand.join(c, "session_id").select(
        "session_id", F.col("candidate_id").alias("stem"), "speakers", F.col("a").alias("asr"), F.col("d").alias("audio"), F.col("l").alias("text_quality"),
        F.transform("speakers", lambda s: F.when(s == F.col("provider"), 1.0).otherwise(0.0)).alias("consistency"))
    d = op.attribute_stems(stems, ["session_id"])
    return d.select("session_id", "stem", "speaker", r6("confidence").alias("confidence"), F.round("probability", 9).alias("probability"))


def features(v):
    e = v.ivl
    return e.select(
        "session_id", F.col("event_id").alias("id"), (F.col("event_id") % 100 / 100.0).alias("voice_ratio"), (F.col("event_id") % 180 * 1.0).alias("energy_variance"),
        (F.col("event_id") % 7 / 10.0).alias("overlap_density"), (F.col("event_id") % 13).alias("changes"), (F.col("event_id") % 11).alias("silences"),
        (F.col("event_id") % 9).alias("valleys"))


@query("H46_chunk_features", with_views("ivl") + """, f AS (SELECT session_id, event_id AS id, event_id%100/1e2 AS vr, event_id%180*1e0 AS ev, event_id%7/1e1 AS od, event_id%13 AS ch, event_id%11 AS si, event_id%9 AS va FROM ivl),
 c AS (SELECT *, least(1,25e-2*vr+15e-2*least(1,ev/100)+3e-1*least(1,od*2)+2e-1*least(1,ch*1e-1)+1e-1*least(1,si*5e-2)) AS complexity FROM f),
 z AS (SELECT *, CASE WHEN od>=4e-1 THEN 5e-1+3e-1*(1-least(1,od)) WHEN od<=15e-2 THEN 13e-1+5e-1*(1-od) ELSE 1-2e-1*(od-15e-2) END AS ov, CASE WHEN round(complexity,9)>=7e-1 THEN 7e-1+3e-1*(1-round(complexity,9)) WHEN round(complexity,9)<=3e-1 THEN 12e-1+3e-1*(1-round(complexity,9)) ELSE 1e0 END AS cx FROM c)
 SELECT session_id, id, round(complexity,6) AS complexity, round(greatest(15,least(30*ov*cx,60)),6) AS chunk_size, round(least(1,3e-1*least(1,si*1e-1)+25e-2*least(1,va*15e-2)+25e-2*greatest(0,1-od)+2e-1*least(1,ch*2e-1)),6) AS boundary_quality FROM z""")
def _(v):
    return op.chunk_features(features(v)).select("session_id", "id", *[r6(c).alias(c) for c in ("complexity", "chunk_size", "boundary_quality")])


@query("H46_plan_chunks")
def _(v):
    f = op.chunk_features(v.seg.select(
        "session_id", "turn", (F.col("start_ms") / 1000.0).alias("f0"), (F.col("end_ms") / 1000.0).alias("f1"), (F.col("n") % 100 / 100.0).alias("voice_ratio"),
        (F.col("n") % 180 * 1.0).alias("energy_variance"), (F.col("turn") % 7 / 10.0).alias("overlap_density"), (F.col("turn") % 13).alias("changes"),
        (F.col("n") % 11).alias("silences"), (F.col("n") % 9).alias("valleys")))
    w = v.word.select("session_id", "turn", (F.col("end_ms") / 1000.0).alias("t"), "word")
    kind = F.when(F.col("word").endswith("."), "pause").when(F.col("word").endswith(","), "energy_valley")
    c = w.withColumn("kind", kind).where("kind is not null").join(f.select("session_id", "turn", F.col("boundary_quality").alias("base")), ["session_id", "turn"]) \
        .select("session_id", "t", "kind", "base", F.when(F.col("kind") == "pause", F.col("t") - 0.2).otherwise(F.col("t")).alias("s0"))
    d = op.plan_chunks(f, c)
    return d.select("session_id", r6("cut").alias("cut"), "kind", r6("quality").alias("quality"))


@query("H47_merge_chunks", with_views("hyp").replace("WITH ", "WITH RECURSIVE ", 1) + """, ch AS (SELECT session_id, turn AS chunk_id, start_ms AS start, end_ms+1500 AS "end" FROM seg), tk AS (SELECT session_id, turn AS chunk_id, (turn*4294967296+pos)*10+engine AS word_id, start_ms AS start, end_ms AS "end", word FROM hyp),
 e AS (SELECT *, lag("end") OVER w AS pe, lead(start) OVER w AS ns FROM ch WINDOW w AS (PARTITION BY session_id ORDER BY start,chunk_id)),
 f AS (SELECT *, CASE WHEN pe-start>10 THEN (pe+start)/2e0 END AS lo, CASE WHEN "end"-ns>10 THEN ("end"+ns)/2e0 END AS hi FROM e),
 k AS (SELECT tk.* FROM tk JOIN f USING (session_id,chunk_id) WHERE (lo IS NULL OR tk.start>lo) AND (hi IS NULL OR tk."end"<=hi)),
 o AS (SELECT *, lower(trim(word)) AS low, coalesce(start-lag(start) OVER w,101)>100 AS fresh FROM k WINDOW w AS (PARTITION BY session_id ORDER BY start,chunk_id,word_id)),
 g AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY session_id ORDER BY start,chunk_id,word_id) AS run FROM o), n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY start,chunk_id,word_id) AS rn FROM g),
 z AS (SELECT *, true AS keep, [{'s':start,'w':low}] AS kept FROM n WHERE rn=1 UNION ALL SELECT n.*, NOT t.twin, CASE WHEN t.twin THEN z.kept ELSE list_append(z.kept,{'s':n.start,'w':n.low})[-3:] END
  FROM z JOIN n ON n.session_id=z.session_id AND n.run=z.run AND n.rn=z.rn+1, LATERAL (SELECT n.low<>'' AND len(list_filter(z.kept, lambda q: abs(n.start-q.s)<=100 AND q.w=n.low))>0 AS twin) t)
 SELECT session_id, chunk_id, word_id, start, "end", word FROM z WHERE keep""")
def _(v):
    chunks = v.seg.select("session_id", F.col("turn").alias("chunk_id"), F.col("start_ms").alias("start"), (F.col("end_ms") + 1500).alias("end"))
    tokens = v.hyp.select(
        "session_id", F.col("turn").alias("chunk_id"), ((F.col("turn") * WORDS + F.col("pos")) * 10 + F.col("engine")).alias("word_id"),
        F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "word")
    return op.merge_chunks(chunks, tokens, MS, WIDTH)
