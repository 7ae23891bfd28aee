"""Vocabulary queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from chorale.functions import strings as st
from chorale.functions.numeric import r6
from chorale.operators import speech as sp, terms as op
from chorale.operators.skew import spread
from chorale.plans.registry import query
from chorale.plans.speech import CTX, UNIT_SQL, _case_sql, _tech_sql, _type_sql
from chorale.plans.turns import HS, hs
from chorale.session import cut_lineage
from chorale.views import WORDS, with_views

DENY = r"dn AS (SELECT DISTINCT CASE WHEN item_id%4=0 THEN w ELSE concat(w,'~') END AS token FROM (SELECT item_id, unnest(string_split_regex(trim(lower(text)),'\s+')) AS w FROM benchmark))"
BACK = r"bk AS (SELECT w AS token, count(*)/sum(count(*)) OVER () AS probability FROM (SELECT unnest(string_split_regex(trim(lower(text)),'\s+')) AS w FROM benchmark) GROUP BY 1)"


def deny(v):
    w = v.table("benchmark").select("item_id", F.explode(F.split(F.trim(F.lower("text")), r"\s+")).alias("w"))
    return w.select(F.when(F.col("item_id") % 4 == 0, F.col("w")).otherwise(F.concat("w", F.lit("~"))).alias("token")).distinct()  # three in four deny no token


def background(v):
    w = v.table("benchmark").select(F.explode(F.split(F.trim(F.lower("text")), r"\s+")).alias("token"))
    c = w.groupBy("token").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total")))).select("token", (F.col("n") / F.col("total")).alias("probability"))


def tokens(v):
    return v.term.select("session_id", "token", "engine", "speaker", op.position(F.col("doc_id"), F.col("pos")).alias("at"))


def contexts(v, stats):
    return op.with_first_context(stats, v.norm.select(F.col("doc_id").alias("text_id"), "text"))


TOK = CTX + """, tks AS (SELECT cx.doc_id%50 AS session_id, token, source AS engine, lang AS speaker, cx.doc_id, pos, context FROM cx JOIN documents d ON d.doc_id=cx.doc_id),
 tst AS (SELECT session_id, token, count(*) AS frequency, list_sort(list_distinct(list(engine))) AS engines, count(DISTINCT engine) AS engine_count, count(DISTINCT speaker) AS speaker_count, arg_min(context,(doc_id,pos)) AS context FROM tks GROUP BY 1,2)"""


@query("D1_token_stats", TOK + " SELECT session_id, token, frequency, array_to_string(engines,',') AS engines, engine_count, speaker_count, array_to_string(context,' ') AS first_context FROM tst")
def _(v):
    return contexts(v, op.token_stats(tokens(v))).select("session_id", "token", "frequency", F.array_join("engines", ",").alias("engines"), "engine_count", "speaker_count",
                                            F.array_join("first_context", " ").alias("first_context"))


FIL = TOK + ", " + DENY + ", " + BACK + """, ft AS (SELECT * FROM tst WHERE length(token) BETWEEN 2 AND 50 AND frequency>=2 AND (NOT regexp_matches(token,'^[0-9]+$') OR regexp_matches(token,'^0*(19[0-9]{2}|20[0-9]{2}|2100)$')) AND lower(token) NOT IN (SELECT token FROM dn))"""


@query("C10_filter_terms", FIL + " SELECT session_id, token, frequency FROM ft")
def _(v):
    return op.filter_terms(op.token_stats(tokens(v)), deny(v)).select("session_id", "token", "frequency")


MINE = FIL + f""", tt AS (SELECT session_id, sum(frequency) AS total FROM tst GROUP BY 1), ms AS (SELECT ft.*, round(25e-2*least(1,ln(frequency/total/coalesce(probability,1e-6)+1)/ln(1e2))+2e-1*{_case_sql('ft.token')}+2e-1*{_tech_sql('ft.token')}+15e-2*least(1,speaker_count/3e0)+2e-1*({UNIT_SQL.replace('lower(token)', 'lower(ft.token)')}),9) AS score
  FROM ft JOIN tt USING (session_id) LEFT JOIN bk ON bk.token=lower(ft.token)), mined AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY score DESC, token) AS INTEGER) AS rank FROM ms WHERE score>=5e-1 QUALIFY rank<=200)"""


def mined(v):
    stats = cut_lineage(op.token_stats(tokens(v)))  # read for the totals, the terms and twice for their contexts
    totals = stats.groupBy("session_id").agg(F.sum("frequency").alias("total"))
    return op.mine_terms(contexts(v, op.filter_terms(stats, deny(v))), totals, background(v))


@query("H24_mine_terms", MINE + " SELECT session_id, token, frequency, round(score,6) AS score, rank FROM mined")
def _(v):
    return mined(v).select("session_id", "token", "frequency", r6("score").alias("score"), "rank")


@query("H25_cluster_variants")
def _(v):
    return op.cluster_variants(mined(v)).withColumn("score", r6("score"))


def base_and_session(v):
    """Project = language; base = terms of even documents, session batch = terms of odd documents."""
    g = op.project_terms(spread(v.table("documents").select("doc_id", "lang", "source", "text"), "doc_id").withColumnRenamed("lang", "project_id"))
    score = F.least(F.lit(1.0), F.length("term") / 12.0 + F.col("docs") / 50.0)
    base = g.where("half = 0").select("project_id", "term", "canonical", F.col("docs").alias("total"), F.col("docs").alias("sessions"), score.alias("mean"), F.lit(0.01).alias("variance"),
                                      F.when(F.length("term") % 5 == 0, 0.104).otherwise(0.9).alias("decay"), F.array_except("forms", F.array("canonical")).alias("variants"), "engines")
    session = g.where("half = 1").select("project_id", F.col("canonical").alias("token"), score.alias("score"), F.array_except("forms", F.array("canonical")).alias("variants"), "engines")
    return base, session


TB = "WITH " + DENY + r""", t AS (SELECT lang AS project_id, doc_id, source, unnest(string_split_regex(trim(text),'\s+')) AS token FROM documents), g AS (SELECT project_id, lower(token) AS term, doc_id%2 AS half, min(token) AS canonical, count(DISTINCT doc_id) AS docs, list_sort(list(DISTINCT source)) AS engines, list_sort(list(DISTINCT token)) AS forms FROM t GROUP BY 1,2,3),
 sc AS MATERIALIZED (SELECT *, least(1,length(term)/12e0+docs/5e1) AS score, list_sort(list_filter(forms, lambda x: x<>canonical)) AS variants FROM g), ba AS MATERIALIZED (SELECT *, CASE WHEN length(term)%5=0 THEN 104e-3 ELSE 9e-1 END AS decay FROM sc WHERE half=0), se AS MATERIALIZED (SELECT sc.*, dn.token IS NOT NULL OR term='' OR score<2e-1 AS denied FROM sc LEFT JOIN dn ON dn.token=lower(trim(canonical)) WHERE half=1),
 mg AS (SELECT coalesce(ba.project_id,se.project_id) AS project_id, coalesce(ba.term,se.term) AS term, coalesce(ba.canonical,se.canonical) AS canonical, ba.term IS NOT NULL AS known, se.term IS NOT NULL AS seen, coalesce(NOT denied,false) AS good, ba.docs, ba.score AS mean, se.score, ba.decay, ba.variants AS bv, se.variants AS sv, ba.engines AS be, se.engines AS sen FROM ba FULL JOIN se ON ba.project_id=se.project_id AND ba.term=se.term),
 mr AS (SELECT project_id, term, canonical, CASE WHEN known AND good THEN 'updated' WHEN good THEN 'added' WHEN NOT known THEN 'denied' WHEN seen THEN 'kept' WHEN round(decay*95e-2,12)<1e-1 THEN 'removed' ELSE 'decayed' END AS status, CASE WHEN known AND good THEN docs+1 WHEN good THEN 1 ELSE docs END AS sessions,
  CASE WHEN known AND good THEN 9e-1*mean+1e-1*score WHEN good THEN score ELSE mean END AS mean, CASE WHEN known AND good THEN 9e-1*1e-2+1e-1*(score-mean)*(score-mean) WHEN good THEN 0 WHEN known THEN 1e-2 END AS variance, CASE WHEN good THEN 1 WHEN seen THEN decay ELSE decay*95e-2 END AS decay,
  CASE WHEN known AND good THEN list_sort(list_concat(bv,(list_sort(list_filter(sv, lambda x: NOT list_contains(bv,x))))[1:greatest(0,10-len(bv))])) WHEN good THEN sv ELSE bv END AS variants, CASE WHEN known AND good THEN list_sort(list_distinct(list_concat(be,sen))) WHEN good THEN sen ELSE be END AS engines FROM mg),
 su AS (SELECT * FROM mr WHERE status NOT IN ('denied','removed'))"""


def merged(v):
    base, session = base_and_session(v)
    return op.merge_term_base(base, session, deny(v))


@query("H26_merge_term_base", TB + " SELECT project_id, term, canonical, status, sessions, round(mean,6) AS mean, round(variance,6) AS variance, round(decay,6) AS decay, coalesce(len(variants),0) AS variants, array_to_string(engines,',') AS engines FROM mr")
def _(v):
    return merged(v).select("project_id", "term", "canonical", "status", F.col("sessions").cast("bigint").alias("sessions"), r6("mean").alias("mean"), r6("variance").alias("variance"),
                            r6("decay").alias("decay"), F.greatest(F.size("variants"), F.lit(0)).cast("bigint").alias("variants"), F.array_join("engines", ",").alias("engines"))


@query("H26_merge_counts", TB + " SELECT project_id, status, count(*) AS n FROM mr GROUP BY 1,2")
def _(v):
    return op.merge_counts(merged(v))


@query("D24_term_base_stats", TB + " SELECT project_id, count(*) AS terms, round(avg(mean),6) AS average_confidence, count(*) FILTER (round(mean,9)>=8e-1) AS high_confidence, count(*) FILTER (len(variants)>0) AS with_variants, round(avg(sessions),6) AS average_sessions, max(sessions) AS max_sessions FROM su GROUP BY 1")
def _(v):
    d = op.term_base_stats(op.surviving(merged(v)))
    return d.select("project_id", "terms", r6("average_confidence").alias("average_confidence"), "high_confidence", "with_variants", r6("average_sessions").alias("average_sessions"), F.col("max_sessions").cast("bigint").alias("max_sessions"))


@query("D24_engine_distribution", TB + ", e AS (SELECT project_id, unnest(engines) AS engine FROM su) SELECT project_id, engine, count(*) AS terms FROM e GROUP BY 1,2")
def _(v):
    return op.engine_distribution(op.surviving(merged(v)))


TOP = TB + ", tw AS (SELECT *, round(mean*4e-1+decay*3e-1+least(1,sessions/1e1)*3e-1,9) AS weight FROM su WHERE round(mean,9)>=5e-1 AND decay>=3e-1), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM tw QUALIFY rank<=50)"


@query("F7_top_terms", TOP + " SELECT project_id, term, round(weight,6) AS weight, rank FROM top")
def _(v):
    return op.top_terms(op.surviving(merged(v))).select("project_id", "term", r6("weight").alias("weight"), "rank")


@query("H27_bias_list", TOP + f" SELECT project_id, term, canonical, round(weight,6) AS weight, {_type_sql('canonical')} AS term_type FROM top")
def _(v):
    return op.bias_list(op.surviving(merged(v)), 50).select("project_id", "term", "canonical", r6("weight").alias("weight"), "term_type")


@query("H27_glossary_weight", TB + ", q AS (SELECT project_id, term FROM ba UNION SELECT project_id, term FROM se) SELECT q.project_id, q.term, round(coalesce(se.score, ba.score*least(1,ba.docs/5e0), 0),6) AS weight FROM q LEFT JOIN se ON se.project_id=q.project_id AND se.term=q.term LEFT JOIN ba ON ba.project_id=q.project_id AND ba.term=q.term")
def _(v):
    base, session = base_and_session(v)
    asked = base.select("project_id", "term").union(session.select("project_id", F.lower("token"))).distinct()
    return op.glossary_weight(asked, session, base).withColumn("weight", r6("weight"))


GLOS = r"""gl AS (SELECT w AS term, least(1,count(*)/1e1) AS weight FROM (SELECT unnest(string_split_regex(trim(lower(text)),'\s+')) AS w FROM benchmark) GROUP BY 1)"""


def glossary(v):
    w = v.table("benchmark").select(F.explode(F.split(F.trim(F.lower("text")), r"\s+")).alias("term"))
    return w.groupBy("term").agg(F.least(F.lit(1.0), F.count("*") / 10.0).alias("weight"))


@query("C9_glossary_bias", with_views("hyp") + ", " + GLOS + """, ge AS (SELECT *, ['e0','e2'] AS engines, [concat(term,'s')] AS variants FROM gl), va AS (SELECT concat(term,'s') AS low, arg_min(term,(-weight,term)) AS term, arg_min(weight,(-weight,term)) AS weight FROM gl GROUP BY 1),
 t AS (SELECT session_id, turn, pos, engine, lower(word) AS low, confidence AS p FROM hyp), j AS (SELECT t.*, g.term AS et, g.weight AS ew, va.term AS vt, va.weight AS vw FROM t LEFT JOIN gl g ON g.term=t.low LEFT JOIN va ON va.low=t.low),
 l AS (SELECT *, coalesce(CASE WHEN et IS NOT NULL THEN least(15e-2,ew*9e-1*1e-1) ELSE least(15e-2,vw*9e-1*5e-2) END,0)*CASE WHEN engine IN (0,2) THEN 12e-1 ELSE 1 END AS lift FROM j)
 SELECT session_id, turn, pos, engine, coalesce(et,vt) AS matched, round(least(1,p+CASE WHEN coalesce(et,vt) IS NULL THEN 0 ELSE lift END),6) AS biased FROM l""")
def _(v):
    g = glossary(v).select("term", "weight", F.lit(0.9).alias("decay"), F.array(F.concat("term", F.lit("s"))).alias("variants"), F.array(F.lit("e0"), F.lit("e2")).alias("engines"))
    t = v.hyp.select("session_id", "turn", "pos", F.concat(F.lit("e"), "engine").alias("engine"), F.col("word").alias("token"), F.col("confidence").alias("posterior"), F.col("engine").alias("eid"))
    return op.apply_glossary_bias(t, g).select("session_id", "turn", "pos", F.col("eid").alias("engine"), "matched", r6("biased").alias("biased"))


@query("D29_lexicon_usage", HS + ", " + GLOS + """, x AS (SELECT session_id, turn, engine, unnest(list_distinct(regexp_extract_all(lower(text),'[a-zA-Z]{3,}'))) AS term FROM hs), m AS (SELECT session_id, turn, engine, count(*) AS words, count(*) FILTER (term IN (SELECT term FROM gl)) AS used FROM x GROUP BY ALL)
 SELECT session_id, turn, engine, words, used, words-used AS novel, round(used/(SELECT count(*) FROM gl),6) AS coverage, round((used*2+words-used)/greatest(words,1),6) AS effectiveness FROM m""")
def _(v):
    d = op.lexicon_usage(hs(v), glossary(v), ["session_id", "turn", "engine"])
    return d.select("session_id", "turn", "engine", "words", "used", "novel", r6("coverage").alias("coverage"), r6("effectiveness").alias("effectiveness"))


SPV = with_views("hyp") + ", " + GLOS + """, spn AS (SELECT session_id, turn*4294967296+pos AS span_id, word AS text, confidence, 2e-1+(engine*3+pos)%7/1e1 AS acoustic FROM hyp), cur AS (SELECT session_id, turn*4294967296+pos AS span_id, arg_max(word,engine) AS text FROM hyp GROUP BY session_id, turn, pos)"""


def span_rows(v):
    sid = F.col("turn") * WORDS + F.col("pos")
    spans = v.hyp.select("session_id", sid.alias("span_id"), F.col("word").alias("text"), "confidence", (0.2 + (F.col("engine") * 3 + F.col("pos")) % 7 / 10.0).alias("acoustic"))
    cur = v.hyp.groupBy("session_id", sid.alias("span_id")).agg(F.max_by("word", "engine").alias("text"))
    return spans, cur


VS = """, gg AS (SELECT session_id, span_id, text, count(*) AS votes, avg(confidence) AS c, avg(acoustic) AS a FROM spn GROUP BY ALL), gs AS (SELECT gg.*, round(votes+c+coalesce(weight,0)*2e-1-CASE WHEN a<5e-1 THEN (5e-1-a)*3e-1 ELSE 0 END{adj},9) AS score FROM gg LEFT JOIN gl ON gl.term=gg.text),
 bs AS (SELECT * FROM gs QUALIFY row_number() OVER (PARTITION BY session_id, span_id ORDER BY score DESC, text)=1), vf AS (SELECT bs.session_id, bs.span_id, bs.text, bs.score, cur.text AS current, bs.score-coalesce(o.score,0) AS margin FROM bs LEFT JOIN cur ON cur.session_id=bs.session_id AND cur.span_id=bs.span_id LEFT JOIN gs o ON o.session_id=cur.session_id AND o.span_id=cur.span_id AND o.text=cur.text)
 SELECT session_id, span_id, current, CASE WHEN text<>coalesce(current,'') AND round(margin,9)>=1e-1 THEN text ELSE coalesce(current,text) END AS verified, round(score,6) AS score, round(margin,6) AS margin, text<>coalesce(current,'') AND round(margin,9)>=1e-1 AS changed FROM vf"""


@query("H23_verify_spans", SPV + VS.replace("{adj}", ""))
def _(v):
    g = glossary(v).withColumnRenamed("term", "text")
    return op.verify_spans(*span_rows(v), g).withColumn("score", r6("score")).withColumn("margin", r6("margin"))


@query("J3_verifier_rules", SPV + VS.replace("{adj}", "+CASE WHEN text IN ('the','of','and') THEN -5e-1 WHEN text='de' THEN 3e-1 ELSE 0 END"))
def _(v):
    g = glossary(v).withColumnRenamed("term", "text")
    rules = v.spark.createDataFrame([("the", -0.5), ("of", -0.5), ("and", -0.5), ("de", 0.3)], "text string, adjustment double")
    return op.verify_spans(*span_rows(v), g, rules).withColumn("score", r6("score")).withColumn("margin", r6("margin"))


@query("G2_allowed_variants", with_views("hyp") + ", " + GLOS + """, se AS (SELECT DISTINCT session_id FROM hyp), tp AS (SELECT term FROM gl ORDER BY weight DESC, term LIMIT 50), al AS (SELECT session_id, word AS text FROM hyp WHERE trim(word)<>'' UNION SELECT session_id, term FROM se, tp), cn AS (SELECT session_id, CASE WHEN (pos+engine)%3=0 THEN concat(word,'~') ELSE word END AS word FROM hyp)
 SELECT session_id, count(*) AS candidates, count(*) FILTER ((session_id,word) IN (SELECT (session_id,text) FROM al)) AS allowed FROM cn GROUP BY 1""")
def _(v):
    spans = v.hyp.select("session_id", F.col("word").alias("text"))
    g = glossary(v).select(F.col("term").alias("canonical"), F.array().cast("array<string>").alias("variants"), "weight")
    c = v.hyp.select("session_id", F.when((F.col("pos") + F.col("engine")) % 3 == 0, F.concat("word", F.lit("~"))).otherwise(F.col("word")).alias("text"))
    d = op.allowed_variants(spans, op.allowed_forms(g), c)
    return d.groupBy("session_id").agg(F.count("*").alias("candidates"), F.count(F.when(F.col("allowed"), 1)).alias("allowed"))


@query("H28_constrain_edits", with_views("seg") + ", " + GLOS + r""", pr AS (SELECT session_id*4294967296+turn AS id, trim(regexp_replace(text,'\s+',' ','g')) AS o, trim(regexp_replace(replace(text,'re','the'),'\s+',' ','g')) AS r FROM seg),
 w AS (SELECT id, unnest(range(len(string_split(o,' ')))) AS i, string_split(o,' ') AS ow, string_split(r,' ') AS rw FROM pr WHERE len(string_split(o,' '))=len(string_split(r,' '))),
 k AS (SELECT id, i, ow[i+1] AS o, rw[i+1] AS r, regexp_replace(lower(ow[i+1]),'[^\p{L}\p{N}_]','','g') AS ok, regexp_replace(lower(rw[i+1]),'[^\p{L}\p{N}_]','','g') AS rk FROM w),
 f AS (SELECT id, i, CASE WHEN ok=rk THEN r WHEN rk IN (SELECT term FROM gl) THEN r ELSE o END AS w, ok<>rk AND rk NOT IN (SELECT term FROM gl) AS lim FROM k)
 SELECT id, string_agg(w,' ' ORDER BY i) AS text, bool_or(lim) AS constrained FROM f GROUP BY 1 UNION ALL SELECT id, r, false FROM pr WHERE len(string_split(o,' '))<>len(string_split(r,' '))""")
def _(v):
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    pairs = v.seg.select((F.col("session_id") * WORDS + F.col("turn")).alias("id"), flat(F.col("text")).alias("original"), flat(F.replace("text", F.lit("re"), F.lit("the"))).alias("repaired"))
    g = glossary(v).select(F.col("term").alias("form"), F.col("term").alias("canonical"))
    return op.constrain_edits(pairs, g)


@query("C19_dialect_boost", with_views("hyp") + r""", lx AS (SELECT DISTINCT regexp_replace(lower(word),'[^\p{L}\p{N}_]','','g') AS word FROM hyp), pt AS (SELECT * FROM (VALUES ('e.*r',1e-1),('^th',2e-1),('on$',5e-2)) t(pattern,boost)), hi AS (SELECT word, least(15e-2,avg(boost)) AS boost FROM lx, pt WHERE regexp_matches(word,pattern) GROUP BY 1),
 j AS (SELECT session_id, turn, engine, confidence, boost FROM hyp LEFT JOIN hi ON hi.word=regexp_replace(lower(hyp.word),'[^\p{L}\p{N}_]','','g')) SELECT session_id, turn, engine, count(*) AS words, count(boost) AS matched, round(coalesce(sum(boost),0)/count(*),6) AS boost, round(least(1,avg(confidence)+coalesce(sum(boost),0)/count(*)),6) AS confidence FROM j GROUP BY 1,2,3""")
def _(v):
    lex = v.hyp.select(F.regexp_replace(F.lower("word"), r"[^\p{L}\p{N}_]", "").alias("word")).distinct().withColumn("phonemes", F.col("word"))
    pats = v.spark.createDataFrame([("e.*r", 0.1), ("^th", 0.2), ("on$", 0.05)], "pattern string, boost double")
    d = op.dialect_boost(v.hyp, lex, pats, ["session_id", "turn", "engine"])
    return d.withColumn("boost", r6("boost")).withColumn("confidence", r6("confidence"))
