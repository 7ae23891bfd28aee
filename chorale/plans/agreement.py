"""Hypothesis agreement and topic similarity queries."""
from __future__ import annotations

from chorale.functions.numeric import r6
from chorale.functions.text import NOT_WORD
from chorale.operators import agreement as op
from chorale.operators.speech import FLOW_STOP
from chorale.plans.linguistic import _in
from chorale.plans.registry import query
from chorale.plans.turns import HS, SG, WIDTH, hs, sg

_GR = " UNION ALL ".join(f"SELECT session_id, turn, engine, {n} AS n, unnest(list_transform(range(1,len(w)-{n}+2), lambda i: array_to_string(w[i:i+{n - 1}],' '))) AS gram FROM cw" for n in op.NGRAM_WEIGHTS)
_WT = "CASE n " + " ".join(f"WHEN {n} THEN {w!r}::DOUBLE" for n, w in op.NGRAM_WEIGHTS.items()) + " END"


@query("H9_ngram_consensus", HS + rf""", cw AS (SELECT session_id, turn, engine, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text),'[^\p{{L}}\p{{N}}_\s.?!,;:]',' ','g'),'\s+',' ','g')),' '), lambda q: length(q)>1 OR {_in('q', op.SHORT_WORDS)}) AS w FROM hs), gr AS ({_GR}),
 g AS (SELECT session_id, turn, engine, n, gram, count(*) AS c FROM gr GROUP BY ALL), gd AS (SELECT g.*, count(*) OVER (PARTITION BY session_id,turn,n,gram) AS df, docs FROM g JOIN (SELECT session_id, turn, count(*) AS docs FROM hs GROUP BY 1,2) USING (session_id,turn)), gw AS (SELECT *, c*ln(docs/df) AS wt FROM gd),
 sz AS (SELECT session_id, turn, engine, n, count(*) AS size, sum(wt) AS mass FROM gw GROUP BY ALL), bo AS (SELECT a.session_id, a.turn, a.n, a.engine AS e1, b.engine AS e2, count(*) AS sh, sum(least(a.wt,b.wt)) AS sm FROM gw a JOIN gw b ON a.session_id=b.session_id AND a.turn=b.turn AND a.n=b.n AND a.gram=b.gram AND a.engine<>b.engine GROUP BY ALL),
 pr AS (SELECT a.session_id, a.turn, a.n, a.engine, coalesce(sh,0)/greatest(a.size+b.size-coalesce(sh,0),1) AS ex, 2*coalesce(sm,0)/greatest(a.mass+b.mass,1) AS idf FROM sz a JOIN sz b ON a.session_id=b.session_id AND a.turn=b.turn AND a.n=b.n AND a.engine<>b.engine LEFT JOIN bo ON bo.session_id=a.session_id AND bo.turn=a.turn AND bo.n=a.n AND bo.e1=a.engine AND bo.e2=b.engine),
 av AS (SELECT session_id, turn, engine, n, avg(ex) AS ex, avg(idf) AS idf FROM pr GROUP BY ALL) SELECT session_id, turn, engine, round(sum(ex*{_WT}),6) AS exact, round(sum(idf*{_WT}),6) AS idf FROM av GROUP BY 1,2,3""")
def _(v):
    d = op.ngram_consensus(v.htext, ["session_id", "turn"])
    return d.select("session_id", "turn", "engine", r6("exact").alias("exact"), r6("idf").alias("idf"))


@query("H10_entity_consensus")
def _(v):
    d = op.entity_consensus(hs(v), ["session_id", "turn"])
    return d.select("session_id", "turn", "engine", *[r6(c).alias(c) for c in ("exact", "category", "density")])


@query("H11_topic_similarity", SG + f""", w AS (SELECT session_id, id, unnest(list_filter(string_split_regex(lower(text),'{NOT_WORD}+'), lambda q: length(q)>1 AND NOT {_in('q', FLOW_STOP)})) AS w FROM sg), tf AS (SELECT session_id, id, w, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT session_id, w, count(*) AS df FROM tf GROUP BY 1,2), dc AS (SELECT session_id, count(*) AS docs FROM sg GROUP BY 1),
 x AS (SELECT tf.session_id, id, tf.w, tf*(ln((1+docs)/(1+df))+1) AS x FROM tf JOIN df ON df.session_id=tf.session_id AND df.w=tf.w JOIN dc ON dc.session_id=tf.session_id), n AS (SELECT *, x/sqrt(sum(x*x) OVER (PARTITION BY session_id,id)) AS u FROM x), e AS (SELECT * FROM (SELECT session_id, id, lead(id) OVER (PARTITION BY session_id ORDER BY start,id) AS n_id FROM sg) WHERE n_id IS NOT NULL),
 d AS (SELECT e.session_id, e.id, sum(a.u*b.u) AS s FROM e JOIN n a ON a.session_id=e.session_id AND a.id=e.id JOIN n b ON b.session_id=e.session_id AND b.id=e.n_id AND b.w=a.w GROUP BY 1,2) SELECT e.session_id, e.id, n_id, round(coalesce(s,0),6) AS similarity FROM e LEFT JOIN d ON d.session_id=e.session_id AND d.id=e.id""")
def _(v):
    return op.topic_similarity(sg(v), ["session_id"], FLOW_STOP, WIDTH).withColumn("similarity", r6("similarity"))
