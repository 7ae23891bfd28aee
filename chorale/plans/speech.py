"""Word, segment, string and flow queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from chorale import words as W
from chorale.functions import entities as ent, strings as st
from chorale.functions.numeric import r6
from chorale.operators import speech as op, turns as tn
from chorale.plans.linguistic import _in, _lit
from chorale.plans.registry import query
from chorale.plans.turns import HS, HW, IV, MS, NB, SG, WIDTH, cut_turns, hs, hyp_words, sg
from chorale.views import with_views

VIEW = with_views


@query("B1_word_key", VIEW("word") + r""" SELECT session_id, turn, pos, regexp_replace(regexp_replace(lower(trim(word)),'[^\p{L}\p{N}_\s]','','g'),'^0+([0-9]+)$','\1') AS key FROM word""")
def _(v):
    return v.word.select("session_id", "turn", "pos", st.word_key("word").alias("key"))


@query("B2_spread_tokens", SG + r""", w AS (SELECT *, string_split_regex(trim(text),'\s+') AS ws, len(string_split_regex(trim(text),'\s+')) AS n FROM sg), x AS (SELECT *, unnest(range(n)) AS p FROM w)
 SELECT session_id, id, CAST(p AS INTEGER) AS pos, ws[p+1] AS token, round(start+p*(("end"-start)/n),6) AS t0, round(start+(p+1)*(("end"-start)/n),6) AS t1 FROM x""")
def _(v):
    return op.spread_tokens(sg(v)).select("session_id", "id", "pos", "token", r6("t0").alias("t0"), r6("t1").alias("t1"))


CLOCKS = [("faster-whisper", 0.0, 1.0), ("deepgram", 0.05, 0.98), ("openai", -0.03, 1.02), ("assemblyai", 0.02, 0.99)]


def clock_words(v):
    names = F.array(*[F.lit(c[0]) for c in CLOCKS])
    return v.hyp.select("session_id", "turn", "pos", "engine", F.element_at(names, (F.col("engine") + 1).cast("int")).alias("provider"),
                        (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"))


@query("B3_normalize_timestamps", VIEW("hyp") + """, c AS (SELECT session_id, turn, pos, engine, start_ms/1e3 AS s, end_ms/1e3 AS e, ([0e0,5e-2,-3e-2])[engine+1] AS o, ([1e0,98e-2,102e-2])[engine+1] AS k FROM hyp),
 n AS (SELECT *, least(greatest(0,(s+o)*k),greatest(0,(e+o)*k)) AS a, greatest(0,(s+o)*k,(e+o)*k) AS z FROM c)
 SELECT session_id, turn, pos, engine, round(CASE WHEN z>2e2+1 AND a>2e2 THEN 1999e-1 ELSE a END,6) AS start, round(CASE WHEN z>2e2+1 THEN 2e2 ELSE z END,6) AS "end" FROM n""")
def _(v):
    table = v.spark.createDataFrame(CLOCKS, "provider string, offset double, scale double")
    d = op.normalize_timestamps(clock_words(v), table, 200.0)
    return d.select("session_id", "turn", "pos", "engine", r6("start").alias("start"), r6("end").alias("end"))


def _ent_sql():
    rows = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS entity_type, unnest(regexp_extract_all(text, '(?i){p.replace(chr(39), chr(39) * 2)}')) AS entity FROM norm"
        for k, p in ent.PATTERNS)
    return VIEW("norm") + f", e AS ({rows})"


@query("B4_entity_counts", _ent_sql() + " SELECT doc_id, entity_type, count(*) AS n, count(DISTINCT lower(entity)) AS kinds, CAST(sum(length(entity)) AS BIGINT) AS chars FROM e GROUP BY 1,2")
def _(v):
    d = ent.entity_matches(v.norm.select("doc_id", "text"))
    return d.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"), F.countDistinct(F.lower("entity")).alias("kinds"),
                                                  F.sum(F.length("entity")).alias("chars"))


def _span_sql(at, kind, pattern):
    p = f"'(?s)(.*?)((?i){pattern.replace(chr(39), chr(39) * 2)})'"
    return f"SELECT doc_id, {at} AS rule, '{kind}' AS entity_type, unnest(regexp_extract_all(text,{p},1)) AS gap, unnest(regexp_extract_all(text,{p},2)) AS entity, generate_subscripts(regexp_extract_all(text,{p},2),1) AS i FROM norm"


_CONTEXT = " ".join(f"WHEN '{kind}' THEN regexp_matches(before,'{'|'.join(words)}')" for kind, words in ent.CONTEXT_WORDS.items())


@query("B4_entity_spans", VIEW("norm") + ", h AS (" + " UNION ALL ".join(_span_sql(i, k, p) for i, (k, p) in enumerate(ent.PATTERNS)) + f"""), pl AS (SELECT *, CAST(sum(length(gap)+length(entity)) OVER (PARTITION BY doc_id, rule ORDER BY i) AS BIGINT) AS b FROM h),
 c AS (SELECT pl.*, b-length(entity) AS a, lower(substr(text, greatest(b-length(entity)-20,0)+1, least(b-length(entity),20))) AS before FROM pl JOIN norm USING (doc_id))
 SELECT doc_id, entity_type, entity, CAST(a AS INTEGER) AS start_char, CAST(b AS INTEGER) AS end_char, round(least(1,5e-1+CASE WHEN coalesce(CASE entity_type {_CONTEXT} END,false) THEN 3e-1 ELSE 0 END+CASE WHEN entity_type='phone_number' AND length(regexp_replace(entity,'[^0-9]','','g'))=10 THEN 2e-1 ELSE 0 END),6) AS validation FROM c""")
def _(v):
    return ent.entity_spans(v.norm.select("doc_id", "text")).withColumn("validation", r6("validation"))


@query("B4_fusion_entity_type", VIEW("term") + ", t AS (SELECT token, count(*) AS n FROM term GROUP BY 1), x AS (SELECT token, n, CASE " + " ".join(
    f"WHEN regexp_matches(token,'{p}') THEN '{k}'" for k, p in ent.FUSION_TYPES) + " END AS entity_type FROM t) SELECT * FROM x WHERE entity_type IS NOT NULL")
def _(v):
    return v.term.groupBy("token").agg(F.count("*").alias("n")).withColumn("entity_type", ent.fusion_type("token")).where("entity_type is not null")


def _case_sql(c):
    r = f"substr({c},2)"
    return f"""CASE WHEN length({c})<=1 THEN 0e0 WHEN {c}=upper({c}) AND regexp_matches({c},'\\p{{Lu}}') THEN 1e0 WHEN regexp_matches({c},'^\\p{{Lu}}') AND regexp_matches({r},'\\p{{Ll}}') THEN 9e-1
 WHEN regexp_matches({r},'\\p{{Lu}}') AND regexp_matches({c},'\\p{{Ll}}') THEN 8e-1 WHEN {c}=lower({c}) AND regexp_matches({c},'\\p{{Ll}}') AND regexp_matches({c},'\\p{{Nd}}|-') THEN 6e-1 WHEN {c}=lower({c}) AND regexp_matches({c},'\\p{{Ll}}') THEN 1e-1 ELSE 3e-1 END"""


def _tech_sql(c):
    return "greatest(" + ",".join(f"CASE WHEN regexp_full_match({c},'{p}') THEN {w!r}::DOUBLE ELSE 0e0 END" for w, p in st.TECHNICAL_SHAPES) + \
        f",CASE WHEN regexp_matches({c},'\\p{{Nd}}') AND regexp_matches({c},'\\p{{L}}') THEN 6e-1 ELSE 0e0 END,CASE WHEN contains({c},'-') AND length({c})>3 THEN 5e-1 ELSE 0e0 END)"


def _type_sql(c):
    r = f"substr({c},2)"
    return f"""CASE WHEN length({c})>=2 AND {c}=upper({c}) AND regexp_matches({c},'\\p{{Lu}}') THEN 'acronym' WHEN regexp_matches({c},'^\\p{{Lu}}') AND regexp_matches({r},'\\p{{Ll}}') THEN 'proper_noun'
 WHEN regexp_matches({c},'\\p{{Nd}}|-') OR (regexp_matches({r},'\\p{{Lu}}') AND regexp_matches({c},'\\p{{Ll}}')) THEN 'technical' ELSE 'general' END"""


@query("B5_B6_token_shape", VIEW("term") + f" SELECT token, count(*) AS n, {_case_sql('token')} AS case_score, {_tech_sql('token')} AS technical_score, {_type_sql('token')} AS term_type FROM term GROUP BY token")
def _(v):
    return v.term.groupBy("token").agg(F.count("*").alias("n")).select(
        "token", "n", st.case_score("token").alias("case_score"), st.technical_score("token").alias("technical_score"),
        st.term_type("token").alias("term_type"))


CTX = VIEW("norm") + r""", tw AS (SELECT doc_id, string_split_regex(trim(text),'\s+') AS w FROM norm), tk AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM tw),
 cx AS (SELECT doc_id, i AS pos, w[i+1] AS token, w[greatest(i-2,1):i+4] AS context FROM tk)"""


@query("E19_token_context", CTX + " SELECT doc_id, pos, token, array_to_string(context,' ') AS context FROM cx")
def _(v):
    return op.token_context(v.norm.select("doc_id", "text")).withColumn("context", F.array_join("context", " "))


UNIT_SQL = f"""CASE WHEN {_in('lower(token)', st.UNITS)} THEN 1e0 ELSE coalesce((SELECT CASE WHEN min(d)<=1 THEN 8e-1 WHEN min(d)<=2 THEN 6e-1 WHEN min(d) IS NOT NULL THEN 4e-1 END
  FROM (SELECT abs(k-1-len(context)//2) AS d FROM (SELECT unnest(range(1,len(context)+1)) AS k) WHERE {_in('lower(context[k])', st.UNITS)} AND list_position(list_transform(context, lambda q: lower(q)), lower(context[k]))=k)),0e0) END"""


@query("B5_unit_score", CTX + f" SELECT doc_id, pos, {UNIT_SQL} AS unit_score FROM cx")
def _(v):
    d = op.token_context(v.norm.select("doc_id", "text"))
    return d.select("doc_id", "pos", st.unit_score("token", "context").alias("unit_score"))


@query("B7_time_formats", VIEW("seg") + """, t AS (SELECT session_id, turn, start_ms AS ms, start_ms//1000 AS s, (start_ms+5)//10 AS cs FROM seg)
 SELECT session_id, turn, printf('%02d:%02d:%02d',s//3600,s%3600//60,s%60) AS clock, printf('%02d:%02d:%02d,%03d',s//3600,s%3600//60,s%60,ms%1000) AS srt, printf('%02d:%02d:%02d.%03d',s//3600,s%3600//60,s%60,ms%1000) AS vtt,
 printf('%d:%02d:%02d.%02d',cs//360000,cs//100%3600//60,cs//100%60,cs%100) AS ass, CASE WHEN s//3600>0 THEN printf('%dh %dm %ds',s//3600,s%3600//60,s%60) WHEN s%3600//60>0 THEN printf('%dm %ds',s%3600//60,s%60) ELSE printf('%ds',s%60) END AS spoken FROM t""")
def _(v):
    ms = F.col("start_ms")
    return v.seg.select("session_id", "turn", st.fmt_clock(ms).alias("clock"), st.fmt_srt(ms).alias("srt"), st.fmt_vtt(ms).alias("vtt"),
                        st.fmt_ass(ms).alias("ass"), st.fmt_duration(ms).alias("spoken"))


WORDPAIR = VIEW("hyp") + ", p AS (SELECT DISTINCT a.word AS w1, b.word AS w2 FROM hyp a JOIN hyp b ON a.session_id=b.session_id AND a.turn=b.turn AND a.pos=b.pos+1 AND b.engine=(a.engine+1)%3)"


def word_pairs(v):
    a = v.hyp.select("session_id", "turn", "pos", ((F.col("engine") + 1) % 3).alias("engine"), F.col("word").alias("w1"))
    b = v.hyp.select("session_id", "turn", (F.col("pos") + 1).alias("pos"), "engine", F.col("word").alias("w2"))
    return a.join(b, ["session_id", "turn", "pos", "engine"]).select("w1", "w2").distinct()


@query("B8_B9_similarity", WORDPAIR + r""", t AS (SELECT w1, w2, regexp_replace(w1,'[^ -~]','?','g') AS m1, regexp_replace(w2,'[^ -~]','?','g') AS m2, list_distinct(string_split_regex(lower(w1),'[\s\-_]+')) AS a, list_distinct(string_split_regex(lower(w2),'[\s\-_]+')) AS b FROM p)
 SELECT w1, w2, round(1-levenshtein(m1,m2)/greatest(length(m1),length(m2)),6) AS edit_sim, round(len(list_intersect(a,b))/len(list_distinct(list_concat(a,b))),6) AS jaccard FROM t""")
def _(v):
    mask = lambda c: F.regexp_replace(c, "[^ -~]", "?")  # noqa: E731  (DuckDB counts bytes, Spark characters)
    return word_pairs(v).select("w1", "w2", r6(st.edit_sim(mask("w1"), mask("w2"))).alias("edit_sim"), r6(st.jaccard("w1", "w2")).alias("jaccard"))


@query("B10_B11_visual_similarity")
def _(v):
    d = word_pairs(v).withColumn("p1", st.plain_term("w1")).withColumn("p2", st.plain_term("w2"))
    return d.select("w1", "w2", r6(st.seq_ratio("w1", "w2")).alias("seq_ratio"), r6(st.visual_sim("w1", "w2", "p1", "p2")).alias("visual_sim"))


@query("B12_formality", VIEW("norm") + f""", w AS (SELECT doc_id, string_split_regex(trim(lower(text)),'\\s+') AS w FROM norm),
 r AS (SELECT doc_id, len(list_filter(w, lambda x: {_in('x', op.FORMAL)}))/len(w) AS formal, len(list_filter(w, lambda x: {_in('x', op.INFORMAL)}))/len(w) AS informal FROM w)
 SELECT doc_id, round(formal,6) AS formal, round(informal,6) AS informal, CASE WHEN formal>informal*2 AND formal>5e-2 THEN 'formal' WHEN informal>formal*2 AND informal>5e-2 THEN 'informal' WHEN abs(formal-informal)<2e-2 THEN 'mixed' ELSE 'neutral' END AS level,
 round(CASE WHEN formal>informal*2 AND formal>5e-2 THEN least(formal*10,1) WHEN informal>formal*2 AND informal>5e-2 THEN least(informal*10,1) WHEN abs(formal-informal)<2e-2 THEN 8e-1 ELSE 6e-1 END,6) AS level_confidence FROM r""")
def _(v):
    d = op.formality(v.norm.select("doc_id", "text"))
    return d.select("doc_id", r6("formal").alias("formal"), r6("informal").alias("informal"), "level", r6("level_confidence").alias("level_confidence"))


def session_texts(v):
    return v.norm.select((F.col("doc_id") % 50).alias("session_id"), "text")


@query("B13_session_vocabulary", VIEW("norm") + f""", g AS (SELECT doc_id%50 AS session_id, text, regexp_extract_all(lower(text),'[a-zA-Z]+') AS g, concat(' ',regexp_replace(text,'([^\\p{{L}}\\p{{N}}_])','\\1\\1','g'),' ') AS sp FROM norm),
 r AS (SELECT session_id, 'word' AS kind, unnest(g) AS term FROM g UNION ALL SELECT session_id, 'acronym', unnest(regexp_extract_all(sp,'{op.ACRONYM}',1)) FROM g UNION ALL SELECT session_id, 'compound', unnest(regexp_extract_all(sp,'{op.COMPOUND}',1)) FROM g
  UNION ALL SELECT session_id, 'digits', unnest(regexp_extract_all(sp,'{op.DIGIT_MIX}',1)) FROM g
  UNION ALL SELECT session_id, 'phrase2', unnest(list_transform(range(1,len(g)), lambda i: concat(g[i],' ',g[i+1]))) FROM g UNION ALL SELECT session_id, 'phrase3', unnest(list_transform(range(1,len(g)-1), lambda i: concat(g[i],' ',g[i+1],' ',g[i+2]))) FROM g),
 f AS (SELECT session_id, kind, term, count(*) AS freq FROM r GROUP BY ALL), t AS (SELECT session_id, sum(freq) AS total FROM f WHERE kind='word' GROUP BY 1)
 SELECT session_id, kind, term, freq, round(CASE WHEN kind='word' AND freq>1 AND length(term)>3 THEN least(freq/total*100,1)*7e-1+least(length(term)/1e1,1)*3e-1 END,6) AS confidence FROM f LEFT JOIN t USING (session_id)
 WHERE kind IN ('acronym','compound','digits') OR (kind='word' AND freq>2 AND length(term)>4 AND NOT {_in('term', op.FLOW_STOP)}) OR (kind='phrase2' AND freq>2) OR (kind='phrase3' AND freq>1)""")
def _(v):
    return op.session_vocabulary(session_texts(v)).withColumn("confidence", r6("confidence"))


@query("C11_pairwise", HS + """ SELECT a.session_id, a.turn, a.engine AS engine1, b.engine AS engine2, round(a.confidence-b.confidence,6) AS gap, len(a.text)-len(b.text) AS longer FROM hs a JOIN hs b ON a.session_id=b.session_id AND a.turn=b.turn AND a.engine<b.engine""")
def _(v):
    d = op.pairwise(hs(v), ["session_id", "turn"])
    return d.select("session_id", "turn", "engine1", "engine2", r6(F.col("confidence1") - F.col("confidence2")).alias("gap"),
                    (F.length("text1") - F.length("text2")).cast("bigint").alias("longer"))


TRIM = """, rk AS (SELECT {k}, confidence AS c, row_number() OVER (PARTITION BY {k} ORDER BY confidence) AS rn, count(*) OVER (PARTITION BY {k}) AS n FROM {t}),
 tm AS (SELECT {k}, max(n) AS n, avg(c) AS trimmed_mean FROM rk WHERE rn>floor(1e-1*n) AND rn<=n-floor(1e-1*n) GROUP BY {k})"""


@query("D9_trimmed_mean", VIEW("hyp") + TRIM.format(k="session_id, engine", t="hyp") + " SELECT session_id, engine, n, round(trimmed_mean,6) AS trimmed_mean FROM tm")
def _(v):
    return op.trimmed_mean(v.hyp, ["session_id", "engine"], "confidence").withColumn("trimmed_mean", r6("trimmed_mean"))


ENT = """, st AS (SELECT session_id, speaker, sum("end"-start) AS t FROM {t} GROUP BY 1,2), stt AS (SELECT *, sum(t) OVER (PARTITION BY session_id) AS tot, count(*) OVER (PARTITION BY session_id) AS k FROM st),
 en AS (SELECT session_id, max(k) AS k, CASE WHEN max(tot)=0 THEN 0e0 ELSE -sum(CASE WHEN t>0 THEN t/tot*log2(t/tot) ELSE 0 END)/CASE WHEN max(k)>1 THEN log2(max(k)) ELSE 1e0 END END AS entropy FROM stt GROUP BY 1)"""


@query("D10_speaker_entropy", IV + ENT.format(t="iv") + " SELECT session_id, k, round(entropy,6) AS entropy FROM en")
def _(v):
    from chorale.plans.turns import iv
    return op.speaker_entropy(iv(v)).withColumn("entropy", r6("entropy"))


@query("D11_speaker_summary", SG + r""", b AS (SELECT session_id, speaker, count(*) AS segments, sum("end"-start)/1e3 AS duration, CAST(sum(len(string_split_regex(trim(text),'\s+'))) AS BIGINT) AS words, avg(confidence) AS confidence FROM sg GROUP BY GROUPING SETS ((session_id,speaker),(session_id))),
 t AS (SELECT session_id, sum("end"-start)/1e3 AS total FROM sg GROUP BY 1)
 SELECT session_id, coalesce(speaker,'*') AS speaker, segments, round(duration,6) AS duration, words, round(confidence,6) AS confidence, round(duration/total*100,6) AS share FROM b JOIN t USING (session_id)""")
def _(v):
    d = op.speaker_summary(sg(v), MS)
    return d.select("session_id", "speaker", "segments", "words", *[r6(c).alias(c) for c in ("duration", "confidence", "share")])


SNAP = """, we AS (SELECT session_id, segment AS id, arg_min(start,(start,word_id)) AS w0, arg_max("end",(start,word_id)) AS w1 FROM hw GROUP BY 1,2),
 sn AS (SELECT *, lead(start) OVER w AS ns, lead(w0) OVER w AS nw FROM sg LEFT JOIN we USING (session_id,id) WINDOW w AS (PARTITION BY session_id ORDER BY start,id)),
 sp AS (SELECT session_id, count(*) AS segments, count(*) FILTER (w1 IS NOT NULL AND nw IS NOT NULL) AS pairs, count(*) FILTER (abs("end"-w1)<=120 AND abs(ns-nw)<=120) AS snapped FROM sn GROUP BY 1),
 snap AS (SELECT *, CASE WHEN segments<2 THEN 1e0 ELSE snapped/greatest(pairs,1) END AS snap FROM sp)"""
HWSG = HW + SG[len(with_views("seg")):]


@query("E1_boundary_snap", HWSG + SNAP + " SELECT * REPLACE (round(snap,6) AS snap) FROM snap")
def _(v):
    words = hyp_words(v).withColumnRenamed("segment", "id")
    return op.boundary_snap(sg(v), words, MS, WIDTH).withColumn("snap", r6("snap"))


MONO = """, ml AS (SELECT *, lead(start) OVER w AS ns, lead(segment) OVER w AS ng FROM {t} WINDOW w AS (PARTITION BY session_id ORDER BY start,word_id)),
 ms AS (SELECT session_id, segment, count(*) AS n, count(ns) AS p, count(*) FILTER ("end"<=ns) AS m, count(*) FILTER (ng=segment) AS q, count(*) FILTER (ng=segment AND "end">ns+50) AS bad FROM ml GROUP BY 1,2),
 mo AS (SELECT session_id, CAST(sum(n) AS BIGINT) AS words, CASE WHEN sum(n)<2 THEN 1e0 ELSE sum(m)/greatest(sum(p),1) END AS monotonicity, avg(1-bad/greatest(q,1)) AS coherence FROM ms GROUP BY 1)"""


@query("E3_monotonicity", HW + MONO.format(t="hw") + " SELECT session_id, words, round(monotonicity,6) AS monotonicity, round(coherence,6) AS coherence FROM mo")
def _(v):
    d = op.monotonicity(hyp_words(v), MS, WIDTH)
    return d.select("session_id", "words", r6("monotonicity").alias("monotonicity"), r6("coherence").alias("coherence"))


@query("D30_decode_summary", HW + """, l AS (SELECT *, lag("end") OVER (PARTITION BY session_id ORDER BY start,word_id) AS pe FROM hw), s AS (SELECT session_id, segment, avg(confidence) AS sc FROM hw GROUP BY 1,2), ss AS (SELECT session_id, count(*) AS segments, avg(sc) AS segment_confidence FROM s GROUP BY 1),
 a AS (SELECT session_id, count(*) AS words, avg(confidence) AS word_confidence, 1-count(*) FILTER (start<pe)/count(*) AS temporal_consistency FROM l GROUP BY 1)
 SELECT session_id, words, segments, round(word_confidence,6) AS word_confidence, round(segment_confidence,6) AS segment_confidence, round(temporal_consistency,6) AS temporal_consistency FROM a JOIN ss USING (session_id)""")
def _(v):
    d = op.decode_summary(hyp_words(v), WIDTH)
    return d.select("session_id", "words", "segments", *[r6(c).alias(c) for c in ("word_confidence", "segment_confidence", "temporal_consistency")])


OVS = """, ovp AS (SELECT a.session_id, sum(least(a."end",b."end")-greatest(a.start,b.start)) AS sh FROM sg a JOIN sg b ON a.session_id=b.session_id AND (a.start<b.start OR (a.start=b.start AND a.id<b.id)) AND b.start<a."end"
  WHERE least(a."end",b."end")-greatest(a.start,b.start)>=100 GROUP BY 1), osh AS (SELECT session_id, sh/talk AS r FROM (SELECT session_id, sum("end"-start) AS talk FROM sg GROUP BY 1) LEFT JOIN ovp USING (session_id))"""


@query("H4_score_d", HWSG + SNAP + ENT.format(t="sg") + OVS + NB.format(t="sg") + """, sm AS (SELECT session_id, CASE WHEN count(*)<3 THEN 1e0 ELSE greatest(0,1-count(*) FILTER (speaker=nn_speaker AND speaker<>n_speaker AND nn_end-start<=3000)/(count(*)-2e0)) END AS smoothness FROM nb GROUP BY 1),
 c AS (SELECT session_id, snap, smoothness, entropy, CASE WHEN r IS NULL THEN 8e-1 WHEN r BETWEEN 5e-2 AND 15e-2 THEN 9e-1 WHEN r<5e-2 THEN 7e-1 ELSE 6e-1 END AS plausibility FROM snap JOIN sm USING (session_id) JOIN en USING (session_id) JOIN osh USING (session_id))
 SELECT session_id, round(snap,6) AS snap, round(smoothness,6) AS smoothness, plausibility, round(entropy,6) AS entropy, round(3e-1*snap+25e-2*smoothness+25e-2*plausibility+2e-1*entropy,6) AS d FROM c""")
def _(v):
    d = op.score_d(sg(v), hyp_words(v).withColumnRenamed("segment", "id"), MS, WIDTH)
    return d.select("session_id", "plausibility", *[r6(c).alias(c) for c in ("snap", "smoothness", "entropy", "d")])


SGO = SG.replace("start_ms AS start, end_ms AS \"end\"", "start_ms AS start, CASE WHEN turn%3=2 THEN start_ms+1500 ELSE end_ms END AS \"end\"").replace("AS confidence, text", "AS confidence, CASE WHEN turn%3=2 AND session_id%2=0 THEN 'okay right' ELSE text END AS text")


@query("H12_score_o", SGO + OVS + f""", sh AS (SELECT session_id, count(*) FILTER ("end"-start<2000) AS short, count(*) FILTER ("end"-start<2000 AND len(string_split_regex(lower(trim(text)),'\\s+'))<=2 AND list_has_any(string_split_regex(lower(trim(text)),'\\s+'),{W.BACKCHANNELS!r})) AS heard FROM sg GROUP BY 1),
 c AS (SELECT session_id, short, heard, CASE WHEN r IS NULL THEN 7e-1 WHEN r BETWEEN 5e-2 AND 15e-2 THEN 85e-2 WHEN r<5e-2 THEN 7e-1 ELSE 6e-1 END AS doubletalk, CASE WHEN short=0 THEN 7e-1 ELSE least(heard/short+3e-1,1) END AS backchannel FROM sh JOIN osh USING (session_id))
 SELECT session_id, short, heard, doubletalk, round(backchannel,6) AS backchannel, round(65e-2*doubletalk+35e-2*backchannel,6) AS o FROM c""")
def _(v):
    brief = F.col("id") % 3 == 2
    d = sg(v).withColumn("end", F.when(brief, F.col("start") + 1500).otherwise(F.col("end"))) \
        .withColumn("text", F.when(brief & (F.col("session_id") % 2 == 0), "okay right").otherwise(F.col("text")))
    return op.score_o(d, MS, WIDTH).withColumn("backchannel", r6("backchannel")).withColumn("o", r6("o"))


@query("H5_score_a")
def _(v):
    words = hyp_words(v)
    turns = cut_turns(v)
    assigned = tn.assign_speakers(words.select("session_id", "word_id", F.col("start").alias("ws"), F.col("end").alias("we")), turns, MS, WIDTH)
    d = op.score_a(words, assigned, turns, MS, WIDTH)
    return d.select("session_id", *[r6(c).alias(c) for c in ("confidence", "alignment", "temporal", "boundary", "coverage", "a")])


def _any(c, pieces):
    return "(" + " OR ".join("contains({}, '{}')".format(c, p.replace("'", "''")) for p in pieces) + ")"


FLOW = SG + f""", fl AS (SELECT *, lead(text) OVER w AS nt, lead(speaker) OVER w AS nsp, lead(start) OVER w AS ns, lead("end") OVER w AS ne, row_number() OVER w AS rn FROM sg WINDOW w AS (PARTITION BY session_id ORDER BY start,id)),
 fa AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(trim(text)),'\\s+'), lambda x: NOT {_in('x', op.FLOW_STOP)})) AS c1, list_distinct(list_filter(string_split_regex(lower(trim(nt)),'\\s+'), lambda x: NOT {_in('x', op.FLOW_STOP)})) AS c2 FROM fl),
 fb AS (SELECT *, CASE WHEN nt IS NOT NULL THEN CASE WHEN len(c1)=0 AND len(c2)=0 THEN 1e0 ELSE len(list_intersect(c1,c2))/greatest(len(list_distinct(list_concat(c1,c2))),1) END END AS lexical,
  CASE WHEN nt IS NOT NULL THEN CASE WHEN speaker=nsp THEN 8e-1 WHEN "end"-start>=2000 AND ne-ns>=2000 THEN 6e-1 ELSE 3e-1 END END AS bonus, speaker<>nsp AS ch,
  CASE WHEN speaker=nsp THEN CASE WHEN {_any('lower(nt)', op.CONTINUING)} THEN 8e-1 ELSE 7e-1 END ELSE CASE WHEN {_any('lower(text)', op.HANDOFF)} THEN 8e-1 ELSE 6e-1 END END AS sps,
  CASE WHEN (ns-"end")/1e3 BETWEEN 0 AND 3 THEN 9e-1 WHEN (ns-"end")/1e3<=5 THEN 7e-1 ELSE 4e-1 END AS ts, ({_any('lower(text)', op.ASKING)} OR contains(text,'?')) AND speaker<>nsp AS asks,
  ({' OR '.join(f"starts_with(lower(nt),'{p}')" for p in op.ANSWERS)}) AS ans, {_any('lower(text)', op.MOMENTUM)} AS mom FROM fa),
 fc AS (SELECT *, 4e-1*lexical+35e-2*sps+25e-2*ts AS tr FROM fb)"""


@query("E20_conversation_flow", FLOW + """, m AS (SELECT session_id, count(*) AS n, count(*) FILTER (mom AND rn>1) AS mo, avg(lexical) AS lexical, avg(bonus) AS bonus, count(*) FILTER (round(tr,9)>=6e-1) AS good, count(*) FILTER (ch) AS ch, count(*) FILTER (asks) AS ak, count(*) FILTER (asks AND ans) AS aw,
  avg(("end"-start)/1e3) AS mean, stddev_pop(("end"-start)/1e3) AS std, greatest(count(*)-1,1) AS pr FROM fc GROUP BY 1),
 q AS (SELECT session_id, n, lexical, bonus, mo/pr AS momentum, CASE WHEN n<2 THEN 8e-1 ELSE good/pr END AS transitions, CASE WHEN n<3 THEN 8e-1 WHEN ch/pr BETWEEN 3e-1 AND 7e-1 THEN 9e-1 WHEN ch/pr BETWEEN 2e-1 AND 8e-1 THEN 7e-1 ELSE 5e-1 END AS alternation,
  (CASE WHEN mean BETWEEN 3 AND 8 THEN 1e0 ELSE greatest(4e-1,1-abs(mean-55e-1)*2e-1) END+greatest(3e-1,CASE WHEN mean>0 THEN least(1,std/greatest(mean,1)) ELSE 5e-1 END))/2 AS length, CASE WHEN n<4 THEN 8e-1 WHEN ak=0 THEN 7e-1 ELSE aw/ak END AS response FROM m)
 SELECT session_id, n, round(lexical,6) AS lexical, round(bonus,6) AS bonus, round(momentum,6) AS momentum, round(transitions,6) AS transitions, alternation, round(length,6) AS length, round(response,6) AS response, round(4e-1*alternation+3e-1*length+3e-1*response,6) AS naturalness FROM q""")
def _(v):
    d = op.conversation_flow(sg(v), MS, WIDTH)
    return d.select("session_id", "n", "alternation", *[r6(c).alias(c) for c in ("lexical", "bonus", "momentum", "transitions", "length", "response", "naturalness")])


@query("E21_topic_development", SG + f""", o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start,id) AS od, count(*) OVER (PARTITION BY session_id) AS n FROM sg),
 s AS (SELECT *, CASE WHEN od<=n//3 THEN 1 WHEN od<=2*(n//3) THEN 2 ELSE 3 END AS section, string_split_regex(lower(trim(text)),'\\s+') AS w FROM o), x AS (SELECT session_id, n, section, od, unnest(range(len(w))) AS p, w FROM s),
 y AS (SELECT session_id, section, regexp_replace(w[p+1],'[^\\p{{L}}\\p{{N}}_]','','g') AS word, od, p FROM x WHERE length(w[p+1])>3 AND NOT {_in('w[p+1]', op.FLOW_STOP)}),
 c AS (SELECT session_id, section, word, count(*) AS c, min((od,p)) AS f FROM y GROUP BY ALL), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY session_id, section ORDER BY c DESC, f)<=10),
 kk AS (SELECT session_id, coalesce(list(word) FILTER (section=1),[]) AS k1, coalesce(list(word) FILTER (section=2),[]) AS k2, coalesce(list(word) FILTER (section=3),[]) AS k3 FROM k WHERE c>=2 GROUP BY 1),
 r AS (SELECT session_id, n, coalesce(k1,[]) AS k1, coalesce(k2,[]) AS k2, coalesce(k3,[]) AS k3 FROM (SELECT session_id, count(*) AS n FROM sg GROUP BY 1) LEFT JOIN kk USING (session_id)),
 q AS (SELECT *, (len(list_intersect(k1,k2))/greatest(len(list_distinct(list_concat(k1,k2))),1)+len(list_intersect(k2,k3))/greatest(len(list_distinct(list_concat(k2,k3))),1))/2 AS co FROM r)
 SELECT session_id, n, CAST(len(k1) AS INTEGER) AS keywords1, CAST(len(k2) AS INTEGER) AS keywords2, CAST(len(k3) AS INTEGER) AS keywords3, round(co,6) AS continuity, CASE WHEN n<4 THEN 7e-1 WHEN co BETWEEN 2e-1 AND 6e-1 THEN 9e-1 WHEN co BETWEEN 1e-1 AND 7e-1 THEN 7e-1 ELSE 5e-1 END AS development FROM q""")
def _(v):
    return op.topic_development(sg(v), WIDTH).withColumn("continuity", r6("continuity"))
