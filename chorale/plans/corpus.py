"""Corpus normalisation, guardrail and punctuation queries over whole documents."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from chorale.functions.numeric import r6
from chorale.functions.text import NOT_WORD
from chorale.operators import corpus as op, protect as pt, token_diff as td
from chorale.plans.linguistic import _in, _ph, _rx
from chorale.plans.registry import query
from chorale.views import with_views


def _sp(x):
    return f"trim(regexp_replace({x},'\\s+',' ','g'))"


def _twice(x, rule):
    return f"regexp_replace(regexp_replace({x},'{rule}','\\1\\2','g'),'{rule}','\\1\\2','g')"


def _rep(w, keep):
    k = f" AND NOT {_in(f'lower({w}[i])', keep)}" if keep else ""
    return f"list_transform(list_filter(range(1,len({w})+1), lambda i: NOT coalesce(i>1 AND lower({w}[i])=lower({w}[i-1]) AND NOT regexp_matches({w}[i],'{NOT_WORD}'){k}, false)), lambda i: {w}[i])"


def _cap(x):
    return f"concat(CASE substr({x},1,1) WHEN 'ß' THEN 'SS' ELSE upper(substr({x},1,1)) END,substr({x},2))"  # full case mapping


def _sent(x):
    return f"list_filter(list_transform(string_split_regex({x},'[.!?]+'), lambda s: {_sp('s')}), lambda s: s<>'')"


def _profile_sql(name):
    p, c = op.PROFILES[name], []
    x = _sp("text")
    for rule in p["fillers"]:
        x = _sp(_twice(x, op.FILLER_RULES[rule]))
    c.append(f"SELECT doc_id, lang, text, string_split({x},' ') AS w FROM norm")
    if p["repeats"]:
        c.append(f"SELECT * REPLACE ({_rep('w', op.EMPHASIS)} AS w) FROM ({c.pop()})")
    if p["names"]:
        c.append(f"SELECT * REPLACE (list_transform(w, lambda q: CASE WHEN {_in('lower(q)', op.NAMES)} THEN {_cap('lower(q)')} ELSE q END) AS w) FROM ({c.pop()})")
    if p["numbers"]:
        c.append(f"SELECT * REPLACE (list_transform(w, lambda q: CASE q {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in op.NUMBER_WORDS.items())} ELSE q END) AS w) FROM ({c.pop()})")
    t = "array_to_string(w,' ')"
    if p["commas"]:
        t = f"regexp_replace({t},'{op.COMMA_RULE}','\\1, \\2 ','g')"
    if p["quotes"]:
        t = f"regexp_replace(regexp_replace({t},'[“”]','\"','g'),'[‘’]','''','g')"
    inner = f"SELECT doc_id, lang, text, {t} AS t FROM ({c.pop()})"
    if p["sentences"]:
        inner = f"SELECT doc_id, lang, text, array_to_string(list_transform({_sent('t')}, lambda s: {_cap('s')}),'. ') AS t FROM ({inner})"
    return f"SELECT doc_id, lang, text, '{name}' AS profile, t AS normalized, len(string_split({_sp('text')},' ')) AS words_before, len(string_split({_sp('t')},' ')) AS words_after FROM ({inner})"


ALL = with_views("norm") + ", nz AS (" + " UNION ALL ".join(_profile_sql(p) for p in op.PROFILES) + ")"


def normalized(v):
    return reduce(DataFrame.unionByName, [op.normalize_corpus(v.norm, p) for p in op.PROFILES])


@query("H48_normalize_corpus", ALL + " SELECT doc_id, profile, normalized, CAST(words_before AS INTEGER) AS words_before, CAST(words_after AS INTEGER) AS words_after FROM nz")
def _(v):
    return normalized(v).select("doc_id", "profile", "normalized", "words_before", "words_after")


@query("H48_normalization_summary", ALL + " SELECT profile, lang, count(*) AS texts, count(*) FILTER (normalized<>text) AS changed, CAST(sum(words_before) AS BIGINT) AS words_before, CAST(sum(words_after) AS BIGINT) AS words_after FROM nz GROUP BY 1,2")
def _(v):
    return op.normalization_summary(normalized(v), ["lang"])


@query("H48_readability", with_views("norm") + f""", s AS (SELECT doc_id, text, {_sent('text')} AS s, string_split({_sp('text')},' ') AS w FROM norm), l AS (SELECT *, len(w) AS n, list_transform(list_filter(w, lambda q: length(q)>3), lambda q: lower(q)) AS l FROM s)
 SELECT doc_id, round(2e-1*CASE WHEN len(s)>0 THEN greatest(0,1-abs(list_avg(list_transform(s, lambda q: len(string_split(q,' '))))-175e-1)/175e-1) ELSE 5e-1 END+15e-2*greatest(0,1-abs({_rx('text', '[.!?,:;]')}/n-1e-1)/1e-1)+25e-2*greatest(0,1-{_ph('lower(text)', ['um', 'uh', 'er', 'ah', 'like', 'you know', 'i mean'])}/n*5)
  +15e-2*CASE WHEN len(s)>0 THEN len(list_filter(s, lambda q: regexp_matches(q,'^\\p{{Lu}}')))/len(s) ELSE 5e-1 END+15e-2*CASE WHEN {_rx('text', NOT_WORD + '[A-Z0-9]{2,}' + NOT_WORD)}>0 THEN 1 ELSE 8e-1 END+1e-1*greatest(0,1-(len(l)-len(list_distinct(l)))/n*2),6) AS readability FROM l""")
def _(v):
    return op.readability(v.norm, "text", "score").select("doc_id", r6("score").alias("readability"))


def _seen(x):
    """The text as patterns see it, see ``protect.plain``."""
    named = f"translate({x},'{pt.NAMED}',concat(chr(1),chr(2),chr(3),chr(4)))"
    return f"regexp_replace(regexp_replace({named},'[^\\x00-\\x7F\\p{{L}}\\p{{N}}]',' ','g'),'[^\\x00-\\x7F]','x','g')"


def _rule_sql(at, r):
    p = f"'(?s)(.*?)({r.pattern})'"
    return f"SELECT doc_id, t, {at} AS rule, '{r.category}' AS category, {r.priority} AS priority, {r.quality!r}::DOUBLE AS quality, unnest(regexp_extract_all(t,{p},1)) AS gap, unnest(regexp_extract_all(t,{p},2)) AS token, generate_subscripts(regexp_extract_all(t,{p},2),1) AS i FROM seen"


SPANS = f""", seen AS MATERIALIZED (SELECT doc_id, text, {_seen('text')} AS t FROM norm), hit AS ({' UNION ALL '.join(_rule_sql(i, r) for i, r in enumerate(pt.rules()))}),
 pl AS (SELECT *, CAST(sum(length(gap)+length(token)) OVER (PARTITION BY doc_id, rule ORDER BY i) AS BIGINT) AS b FROM hit), wh AS (SELECT doc_id, t, rule, category, priority, quality, token, b-length(token) AS a, b FROM pl),
 sc AS (SELECT *, round(priority*5e-1+least(1e0, quality*CASE WHEN b-a<3 THEN 8e-1 WHEN b-a>20 THEN 9e-1 ELSE 1e0 END*CASE WHEN a>0 AND regexp_matches(substr(t,a,1),'[A-Za-z0-9]') THEN 9e-1 ELSE 1e0 END*CASE WHEN regexp_matches(substr(t,b+1,1),'[A-Za-z0-9]') THEN 9e-1 ELSE 1e0 END
  *CASE WHEN regexp_matches(token,'[0-9]') AND regexp_matches(token,'[A-Za-z]') THEN 11e-1 ELSE 1e0 END)*3e1+quality*2e1,6) AS score FROM wh),
 gr AS (SELECT *, CASE WHEN a >= coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a,b,rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) THEN 1 ELSE 0 END AS fresh FROM sc),
 ig AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a,b,rule) AS span FROM gr),
 sp AS MATERIALIZED (SELECT doc_id, span, min(a) AS a, max(b) AS b, arg_min(category,(-score,a,b,rule)) AS category, array_to_string(list_sort(list_distinct(list(category))),'+') AS categories, count(*) AS matches, max(score) AS score FROM ig GROUP BY 1,2)"""


@query("H48_protected_spans", with_views("norm") + SPANS + """ SELECT doc_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", substr(text,a+1,b-a) AS token, category, categories, CAST(matches AS INTEGER) AS matches, round(score,6) AS score FROM sp JOIN norm USING (doc_id)""")
def _(v):
    return pt.protected_spans(v.norm, ["doc_id"]).withColumn("score", r6("score"))


def _protected_sql(name):
    """The profile over texts with marks in place of spans, and the spans back."""
    return _profile_sql(name).replace("FROM norm", "FROM hidden")


HIDDEN = with_views("norm") + SPANS + f""", ed AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b, a AS o FROM (SELECT doc_id, a, b FROM sp UNION ALL SELECT doc_id, -1, 0 FROM norm)),
 mk AS (SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(text,CAST(a+1 AS BIGINT)) ELSE substr(text,CAST(a+1 AS BIGINT),CAST(b-a AS BIGINT)) END, '{pt.MARK}' ORDER BY a, o) AS masked FROM ed JOIN norm USING (doc_id) GROUP BY 1),
 hd AS (SELECT doc_id, list(substr(text,a+1,b-a) ORDER BY a) AS held FROM sp JOIN norm USING (doc_id) GROUP BY 1),
 hidden AS MATERIALIZED (SELECT doc_id, lang, masked AS text FROM norm JOIN mk USING (doc_id)), nz AS ({" UNION ALL ".join(_protected_sql(p) for p in op.PROFILES)}),
 bk AS (SELECT nz.doc_id, profile, norm.text, coalesce(held,[]) AS held, string_split(normalized,'{pt.MARK}') AS gaps FROM nz JOIN norm USING (doc_id) LEFT JOIN hd USING (doc_id)),
 rs AS (SELECT doc_id, profile, text, len(held) AS protected, array_to_string(list_transform(range(1,len(gaps)+1), lambda i: concat(gaps[i],held[i])),'') AS normalized FROM bk)"""


@query("H48_normalize_protected", HIDDEN + f""" SELECT doc_id, profile, normalized, CAST(len(string_split({_sp('text')},' ')) AS INTEGER) AS words_before, CAST(len(string_split({_sp('normalized')},' ')) AS INTEGER) AS words_after, CAST(protected AS INTEGER) AS protected FROM rs""")
def _(v):
    return pt.normalize_protected_profiles(v.norm, ["doc_id"], op.PROFILES)


TOKS = "list_distinct(list_filter(string_split_regex(lower({x}),'[^\\p{L}\\p{N}_]+'), lambda q: q<>''))"


def _toks(x):
    return TOKS.replace("{x}", x)


PAIRS = with_views("norm") + f""", pr AS (SELECT doc_id, lang, text AS original, normalized FROM ({_profile_sql('executive')})), tk AS (SELECT *, {_toks('original')} AS o, {_toks('normalized')} AS n FROM pr),
 tc AS (SELECT *, list_filter(n, lambda q: NOT list_contains(o,q) AND NOT {_in('q', op.NUMBER_WORDS.values())}) AS added, list_filter(o, lambda q: NOT list_contains(n,q)) AS removed, list_filter(o, lambda q: list_contains(n,q)) AS preserved FROM tk),
 tr AS (SELECT *, CASE WHEN len(o)>0 THEN len(added)/len(o) WHEN len(added)>0 THEN 1e0 ELSE 0e0 END AS cr FROM tc)"""


def pairs(v):
    d = op.normalize_corpus(v.norm, "executive")
    return d.select("doc_id", "lang", F.col("text").alias("original"), "normalized")


@query("G3_token_changes", PAIRS + " SELECT doc_id, CAST(len(added) AS INTEGER) AS added, CAST(len(removed) AS INTEGER) AS removed, CAST(len(preserved) AS INTEGER) AS preserved, round(cr,6) AS change_ratio FROM tr")
def _(v):
    d = op.token_changes(pairs(v))
    return d.select("doc_id", F.size("added").alias("added"), F.size("removed").alias("removed"), F.size("preserved").alias("preserved"), r6("change_ratio").alias("change_ratio"))


_PROT = rf"{NOT_WORD}([A-Z]{{2,}}[0-9]*|[0-9]+[A-Z]+|[A-Za-z]+[0-9]+){NOT_WORD}"
AUD = PAIRS + f""", au AS (SELECT doc_id, lang, cr, len(added) AS invented, len(list_filter(removed, lambda q: {_in('q', op.NEGATIONS)})) AS ng, len(list_filter(removed, lambda q: {_in('q', op.QUANTIFIERS)})) AS qn, len(list_filter(removed, lambda q: {_in('q', op.CONNECTORS)})) AS cn,
  len(list_filter(list_distinct(regexp_extract_all(concat(' ',original,' '),'{_PROT}',1)), lambda q: NOT contains(normalized,q))) AS pl FROM tr),
 ac AS (SELECT *, CASE WHEN cr>1e-1 THEN 1 ELSE 0 END+CASE WHEN ng>0 THEN 1 ELSE 0 END+CASE WHEN pl>0 THEN 1 ELSE 0 END AS critical, CASE WHEN qn>0 THEN 1 ELSE 0 END+CASE WHEN cn>0 THEN 1 ELSE 0 END AS moderate FROM au)"""


@query("H49_guardrail_audit", AUD + """ SELECT doc_id, CAST(invented AS INTEGER) AS invented, CAST(ng AS INTEGER) AS negations_lost, CAST(qn AS INTEGER) AS quantifiers_lost, CAST(cn AS INTEGER) AS connectors_lost, CAST(pl AS INTEGER) AS protected_lost, round(cr,6) AS change_ratio, critical, moderate, critical=0 AS passed,
 round(greatest(0,1-critical*3e-1-moderate*1e-1),6) AS confidence, CASE WHEN critical>=2 THEN 'verbatim' WHEN critical=1 THEN 'light' ELSE 'keep' END AS advice FROM ac""")
def _(v):
    d = op.guardrail_audit(pairs(v))
    return d.select("doc_id", "invented", "negations_lost", "quantifiers_lost", "connectors_lost", "protected_lost", r6("change_ratio").alias("change_ratio"), "critical", "moderate", "passed",
                    r6("confidence").alias("confidence"), "advice")


@query("H49_guardrail_summary", AUD + " SELECT lang, count(*) AS pairs, count(*) FILTER (critical=0) AS passed, CAST(sum(invented) AS BIGINT) AS invented, round(avg(cr),6) AS mean_change, round(min(greatest(0,1-critical*3e-1-moderate*1e-1)),6) AS min_confidence FROM ac GROUP BY 1")
def _(v):
    d = op.guardrail_summary(op.guardrail_audit(pairs(v)), ["lang"])
    return d.withColumn("mean_change", r6("mean_change")).withColumn("min_confidence", r6("min_confidence"))


@query("H49_token_diff")
def _(v):
    return td.token_diff(pairs(v)).select("doc_id", *td.COUNTS)


@query("H49_protection_checks")
def _(v):
    return td.protection_checks(pairs(v), ["doc_id"])


@query("H49_timing_drift", with_views("hyp") + """, ed AS MATERIALIZED (SELECT session_id, turn, pos, max(start_ms) FILTER (engine=0) AS s0, max(end_ms) FILTER (engine=0) AS e0, max(start_ms) FILTER (engine=1) AS s1, max(end_ms) FILTER (engine=1) AS e1 FROM hyp GROUP BY 1,2,3),
 df AS (SELECT *, greatest(abs(s0-s1),abs(e0-e1)) AS drift FROM ed WHERE s0 IS NOT NULL AND s1 IS NOT NULL) SELECT session_id, turn, pos, drift, CASE WHEN drift/3e1<=15e-1 THEN 'minor' WHEN drift/3e1<=3 THEN 'moderate' ELSE 'severe' END AS severity FROM df WHERE drift>30""")
def _(v):
    side = lambda e: v.hyp.where(F.col("engine") == e).select("session_id", "turn", "pos", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return op.timing_drift(side(0), side(1), ["session_id", "turn"], 30.0)


def _punct_sql(level):
    x = _sp("text")
    if "pause" in op.LEVELS[level]:
        x = f"regexp_replace({x},'(?i)(?:\\[pause\\]|\\[silence\\]){{2,}}','[pause]','g')"
    for rule in ("all", "phrases"):
        if rule in op.LEVELS[level]:
            x = _sp(_twice(x, op.FILLER_RULES[rule]))
    a = f"SELECT doc_id, text, string_split({x},' ') AS w FROM norm"
    if "repeats" in op.LEVELS[level]:
        a = f"SELECT * REPLACE ({_rep('w', [])} AS w) FROM ({a})"
    a = f"SELECT doc_id, array_to_string(w,' ') AS t, len(string_split({_sp('text')},' '))-len(w) AS removed FROM ({a})"
    a = f"SELECT doc_id, removed, {_rx('t', op.PUNCT_COMMA)} AS commas, regexp_replace(t,'{op.PUNCT_COMMA}','\\1, \\2 ','g') AS t FROM ({a})"
    a = f"SELECT *, NOT regexp_matches(t,'[.!?]$') AS period_added, CASE WHEN NOT regexp_matches(t,'[.!?]$') THEN concat(t,'.') ELSE t END AS u FROM ({a})"
    return with_views("norm") + f""" SELECT doc_id, CAST(removed AS INTEGER) AS removed, CAST(commas AS INTEGER) AS commas, period_added, array_to_string(list_transform(regexp_extract_all(u,'([^.!?]+|[.!?]+)',1), lambda s: CASE WHEN starts_with(s,' ') THEN concat(' ',{_cap('ltrim(s)')}) ELSE {_cap('s')} END),'') AS punctuated, round(greatest(3e-1,1-removed*1e-1),6) AS confidence FROM ({a})"""


for _level in op.LEVELS:
    @query(f"H50_punctuate_{_level}", _punct_sql(_level))
    def _(v, level=_level):
        d = op.punctuate_corpus(v.norm.select("doc_id", "text"), level)
        return d.select("doc_id", "removed", "commas", "period_added", "punctuated", r6("confidence").alias("confidence"))
