"""Text score queries over the document corpus."""
from __future__ import annotations

from chorale import words as W
from chorale.functions.numeric import r6
from chorale.functions.text import NOT_WORD, WORD, phrase_pattern
from chorale.operators import linguistic as op
from chorale.plans.registry import query
from chorale.views import with_views


def _in(x, words):
    return f"{x} IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _n(items, test):
    return f"len(list_filter({items}, lambda x: {test}))"


def _pairs(items, test, step=1):
    return f"len(list_filter(list_zip({items}, {items}[{1 + step}:]), lambda p: coalesce(p[2] IS NOT NULL AND ({test}), false)))"


def _rx(text, pattern):
    return f"len(regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def _ph(text, phrases):
    spaced = f"concat(' ',regexp_replace({text},'({NOT_WORD})','\\1\\1','g'),' ')"
    return _rx(spaced, phrase_pattern(phrases))


def _lit(text, piece):
    p = piece.replace("'", "''")
    return f"((length({text})-length(replace({text},'{p}','')))//{len(piece)})"


def _band(x, lo, hi, floor, centre, slope):
    return f"(CASE WHEN {x} BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE THEN 1e0 ELSE greatest({floor}::DOUBLE, 1e0-abs({x}-{centre}::DOUBLE)*{slope}) END)"


def _ratio(words):
    return f"({_n('low', _in('x', words))}/n)"


BASE = with_views("norm") + r""", t0 AS (SELECT doc_id, text, string_split(trim(regexp_replace(text,'\s+',' ','g')),' ') AS w FROM norm),
 t1 AS (SELECT *, len(w) AS n, list_transform(w, lambda x: trim(lower(x),'.,!?;:')) AS low, list_filter(list_transform(w, lambda x: regexp_replace(lower(x),'[^\p{L}\p{N}_]','','g')), lambda x: x<>'') AS clean,
  list_filter(list_transform(string_split_regex(text,'[.!?]+'), lambda s: trim(regexp_replace(s,'\s+',' ','g'))), lambda s: s<>'') AS sent FROM t0),
 t2 AS (SELECT *, list_filter(sent, lambda s: len(string_split(s,' '))>=3) AS lng FROM t1)"""

ART = _ratio(W.ARTICLES)
CON = _ratio(W.CONJUNCTIONS)
_A = lambda x: _in(x, W.ARTICLES)
TEXT_SQL = BASE + f""", t3 AS (SELECT *, len(clean) AS c, len(list_distinct(clean)) AS u, list_transform(lng, lambda s: len(string_split(s,' '))) AS ls,
  list_transform(lng, lambda s: list_distinct(list_filter(list_transform(string_split(s,' '), lambda q: trim(lower(q),'.,!?;:')), lambda q: NOT {_in('q', W.TOPIC_STOP)} AND length(q)>2))) AS tp,
  list_transform(list_filter(list_transform(range(len(w)), lambda i: {{'b': regexp_replace(w[i+1],'[^\\p{{L}}\\p{{N}}_]','','g'), 's': i=0 OR coalesce(regexp_matches(w[i],'[.,!?;:]$'),false)}}), lambda m: length(m.b)>1 AND regexp_matches(m.b,'^\\p{{Lu}}') AND NOT m.s), lambda m: lower(m.b)) AS nm,
  {_ph('lower(text)', W.PAST)} AS pa, {_ph('lower(text)', W.PRESENT)} AS pr, {_ph('lower(text)', W.FUTURE)} AS fu FROM t2),
 t4 AS (SELECT doc_id, n, CASE WHEN c=0 THEN 0e0 ELSE (least(1e0,u/c*2e0)+{_band("list_avg(list_transform(clean, lambda x: length(x)))", 4, 7, 0.3, 5.5, "2e-1")}
   +{_band('(' + _n('clean', _in('x', W.SIMPLE)) + '/c)', 0.15, 0.35, 0.4, 0.25, 3)}+greatest(0e0,1e0-(c-u)/c*2))/4 END AS vocabulary,
  ((CASE WHEN n<10 THEN 7e-1 WHEN {ART} BETWEEN 8e-2 AND 15e-2 THEN 1e0 WHEN {ART} BETWEEN 5e-2 AND 2e-1 THEN 8e-1 ELSE 5e-1 END)
   +(CASE WHEN len(lng)<2 THEN 6e-1 ELSE ({_band('list_avg(ls)', 8, 20, 0.4, 14, "1e-1")}+least(1e0,list_stddev_pop(ls)/5e0))/2 END)
   +greatest(3e-1,1e0-{_pairs('low', f"({_A('p[1]')} AND {_A('p[2]')}) OR ({_in('p[1]', W.DEGREE)} AND {_in('p[2]', W.JOINERS)})")}/greatest(n-1,1)*3)
   +(CASE WHEN n<10 THEN 7e-1 WHEN {CON} BETWEEN 3e-2 AND 8e-2 THEN 1e0 WHEN {CON} BETWEEN 1e-2 AND 12e-2 THEN 8e-1 ELSE 5e-1 END))/4 AS grammar,
  greatest(0e0,1e0-{_pairs('low', f"({_A('p[1]')} AND {_A('p[2]')}) OR ({_in('p[1]', W.SHORT_PREPOSITIONS)} AND {_in('p[2]', W.SHORT_PREPOSITIONS)}) OR ({_in('p[1]', W.QUESTION_STARTS)} AND {_in('p[2]', W.QUESTION_STARTS)}) OR {_in('concat(p[1],chr(32),p[2])', W.UNLIKELY_PAIRS)}")}/greatest(n-1,1)*5) AS combination,
  CASE WHEN n<10 OR len(lng)<2 THEN 6e-1 ELSE (least(1e0,list_avg(list_transform(list_filter(list_zip(tp,tp[2:]), lambda p: p[2] IS NOT NULL), lambda p: CASE WHEN len(p[1])=0 OR len(p[2])=0 THEN 0e0 ELSE len(list_intersect(p[1],p[2]))/len(list_distinct(list_concat(p[1],p[2]))) END))*4)
   +(CASE WHEN len(list_filter(lng, lambda s: len(list_filter(string_split(s,' '), lambda q: {_in("trim(lower(q),'.,!?;:')", W.THIRD_PERSON)}))>0))>0 THEN 7e-1 ELSE 8e-1 END)
   +(CASE WHEN pa+pr+fu=0 THEN 7e-1 WHEN greatest(pa,pr,fu)/(pa+pr+fu)>=7e-1 THEN 9e-1 WHEN greatest(pa,pr,fu)/(pa+pr+fu)>=5e-1 THEN 8e-1 ELSE 6e-1 END))/3 END AS coherence,
  CASE WHEN len(nm)=0 THEN 8e-1 ELSE greatest(3e-1,{_n('nm', f"(length(x)>=3 AND regexp_matches(x,'{W.NAME_ENDINGS}')) OR NOT {_in('x', W.NOT_NAMES)}")}/len(nm)) END AS names_score,
  CASE WHEN n<10 THEN 7e-1 ELSE ({_band(ART, 0.08, 0.15, 0.4, 0.12, 5)}+{_band(_ratio(W.PREPOSITIONS), 0.10, 0.20, 0.4, 0.15, 3)}+{_band(_ratio(W.PRONOUNS), 0.08, 0.18, 0.4, 0.13, 3)}+{_band(_ratio(W.AUXILIARIES), 0.08, 0.16, 0.4, 0.12, 4)})/4 END AS function_words FROM t3)"""
TEXT_COLS = ["vocabulary", "grammar", "combination", "coherence", "names_score", "function_words"]


def _rounded(cols):
    return ", ".join(f"round({c},6) AS {c}" for c in cols)


def _show(d, cols):
    return d.select("doc_id", *[r6(c).alias(c) for c in cols])


@query("H6_score_text", TEXT_SQL + f""" SELECT doc_id, {_rounded([c for c in TEXT_COLS])}, round(CASE WHEN n<5 THEN 5e-1 ELSE least(1,greatest(0,2e-1*vocabulary+25e-2*grammar+2e-1*combination+15e-2*coherence+1e-1*names_score+1e-1*function_words)) END,6) AS l_text FROM t4""")
def _(v):
    return _show(op.score_text(v.norm), [*TEXT_COLS, "l_text"])


_D = {c: _lit("text", c) for c in ".?!,"}
_TOT = f"({_D['.']}+{_D['?']}+{_D['!']}+{_D[',']})"
_ERR = "+".join(_rx("text", p) for p in (r"\s+[.!?]", f"[.!?]{WORD}", r"\s+,", r",[^\s]", r"[.!?]{2,}", r"\s+[;:]"))
_ABB = _ph("lower(text)", W.ABBREVIATIONS)
_DOT = _rx("concat(' ',lower(text))", f"{NOT_WORD}(?:{'|'.join(W.ABBREVIATIONS)})\\.{WORD}")
_PRO = _rx("text", W.CONTRACTED)
_LOO = _rx("text", W.UNCONTRACTED)
_LI, _LC = _rx("text", rf"{WORD}+\s+{WORD}+\s+and\s+{WORD}+"), _rx("text", rf"{WORD}+,\s+{WORD}+\s+and\s+{WORD}+")
_QW = _ph("lower(text)", W.QUESTION_WORDS)


def _bal(a, b):
    off = f"abs({_lit('text', a)}-{_lit('text', b)})"
    return f"(CASE WHEN {off}=0 THEN 1e0 ELSE greatest(0e0,1e0-{off}*2e-1) END)"


def _gaps(flag):
    at = f"list_filter(list_transform(range(len(w)), lambda i: CASE WHEN {flag} THEN i END), lambda i: i IS NOT NULL)"
    return f"list_zip(list_concat([-1],{at}), list_concat({at},[len(w)]))"


PUNCT_SQL = BASE + f""", u1 AS (SELECT *, list_transform(range(len(w)), lambda i: {{'x': w[i+1], 'b': regexp_replace(w[i+1],'[^\\p{{L}}\\p{{N}}_]','','g'), 's': i=0 OR coalesce(regexp_matches(w[i],'[.!?]'),false)}}) AS mk,
   {_gaps("regexp_matches(w[i+1],'[.!?]')")} AS eg, {_gaps("NOT regexp_matches(regexp_replace(w[i+1],'[^\\p{L}\\p{N}_]','','g'),'^\\p{Lu}')")} AS cg FROM t2),
 u2 AS (SELECT *, list_transform(list_filter(mk, lambda m: length(m.b)>1 AND regexp_matches(m.b,'^\\p{{Lu}}') AND NOT m.s), lambda m: lower(m.b)) AS inn,
   list_filter(cg, lambda g: g[2]-g[1]-1>=2) AS ru, list_filter(list_transform(mk, lambda m: m.b), lambda b: length(b) BETWEEN 2 AND 6 AND regexp_matches(b,'\\p{{Lu}}') AND b=upper(b)) AS ac,
   {_n('sent', "regexp_matches(x,'^\\p{Lu}')")}/len(sent) AS cap FROM u1),
 u3 AS (SELECT doc_id, CASE WHEN {_D['.']}+{_D['?']}+{_D['!']}=0 OR len(sent)=0 THEN 3e-1 ELSE 5e-1*cap+3e-1*{_band("list_avg(list_transform(sent, lambda s: len(string_split(s,' '))))", 5, 25, 0.4, 15, "5e-2")}
   +2e-1*(CASE WHEN {_TOT}=0 THEN 5e-1 ELSE ({_band(f"({_D['.']}/{_TOT})", 0.6, 0.8, 0.5, 0.7, 2)}+{_band(f"({_D[',']}/{_TOT})", 0.15, 0.3, 0.7, 0.22, 3)})/2 END) END AS boundary,
  CASE WHEN n<10 THEN 7e-1 ELSE 5e-1*greatest(0e0,1e0-list_sum(list_transform(eg, lambda g: greatest(g[2]-g[1]-31,0)))*2e-2)+3e-1*(CASE WHEN {_LI}>0 THEN {_LC}/{_LI} ELSE 8e-1 END)+2e-1*(CASE WHEN {_QW}>0 THEN least(1e0,{_D['?']}/{_QW}) ELSE 8e-1 END) END AS missing,
  5e-1*greatest(0e0,1e0-({_ERR})/n*10)+25e-2*(CASE WHEN {_ABB}=0 THEN 8e-1 ELSE {_DOT}/{_ABB} END)+25e-2*(CASE WHEN {_PRO}+{_LOO}=0 THEN 8e-1 ELSE {_PRO}/({_PRO}+{_LOO}) END) AS placement,
  3e-1*{_bal('(', ')')}+2e-1*{_bal('[', ']')}+2e-1*(CASE WHEN {_lit('text', '"')}%2=0 THEN 1e0 ELSE 7e-1 END)+1e-1*(CASE WHEN ({_lit('text', "'")}-{_rx('text', WORD + "+'" + WORD + "+")})%2=0 OR {_lit('text', "'")}=0 THEN 1e0 ELSE 8e-1 END)
   +2e-1*(CASE WHEN {_rx('text', '"[^"]*"')}=0 THEN 9e-1 ELSE greatest(3e-1,1e0-{_rx('text', '"[.!?,]')}/{_rx('text', '"[^"]*"')}) END) AS matching,
  CASE WHEN n<5 THEN 6e-1 ELSE 25e-2*(CASE WHEN len(sent)=0 THEN 5e-1 ELSE cap END)+25e-2*(CASE WHEN len(inn)=0 THEN 8e-1 ELSE {_n('inn', f"regexp_matches(x,'{W.PLACE_NAMES}') OR NOT {_in('x', W.COMMON_LOWER)}")}/len(inn) END)
   +2e-1*(CASE WHEN len(ru)=0 THEN 8e-1 ELSE len(list_filter(ru, lambda g: g[2]-g[1]-1<=6 AND len(list_filter(w[g[1]+2:g[2]], lambda x: NOT {_in('x', W.TITLE_FUNCTION)}))>0))/len(ru) END)
   +15e-2*(CASE WHEN n<10 OR {_n('w', "regexp_matches(x,'^\\p{Lu}')")}=0 THEN 8e-1 ELSE greatest(0e0,1e0-len(list_filter(mk, lambda m: regexp_matches(m.x,'^\\p{{Lu}}') AND {_in('lower(m.b)', W.LOWER_CASE_WORDS)} AND NOT m.s))/{_n('w', "regexp_matches(x,'^\\p{Lu}')")}*2) END)
   +15e-2*(CASE WHEN len(ac)=0 THEN 8e-1 ELSE {_n('ac', f"{_in('x', W.ACRONYMS)} OR length(x)=2 OR NOT regexp_matches(x,'^([AEIOU]+|[BCDFGHJKLMNPQRSTVWXYZ]+)$')")}/len(ac) END) END AS capitals FROM u2)"""
PUNCT_COLS = ["boundary", "missing", "placement", "matching", "capitals"]


@query("H7_score_punctuation", PUNCT_SQL + f""" SELECT doc_id, {_rounded(PUNCT_COLS)}, round(least(1,greatest(0,25e-2*boundary+2e-1*missing+2e-1*placement+15e-2*matching+2e-1*capitals)),6) AS l_punct FROM u3""")
def _(v):
    return _show(op.score_punctuation(v.norm), [*PUNCT_COLS, "l_punct"])


def _echo(step):
    same = " AND ".join(f"low[i+{k}]=low[i+{k + step}]" for k in range(1, step + 1))
    return f"len(list_filter(range(len(w)), lambda i: coalesce({same}, false)))*{step}"


_FIL = f"({_n('low', _in('x', W.FILLERS))}+{_ph('lower(text)', W.DISCOURSE)}+{_ph('lower(text)', W.FALSE_STARTS)}+{_n('low', _in('x', W.HESITATIONS))})/n"
_BARE = "regexp_replace(lower(x),'[^\\p{L}\\p{N}_]','','g')"
_REP = f"({_pairs('low', 'p[1]=p[2] AND length(p[1])>2')}+{_echo(2)}+{_echo(3)}+{_n('w', f'length({_BARE})>=4 AND substr({_BARE},1,2)=substr({_BARE},3,2)')}+{_n('low[2:n-1]', _in('x', W.CORRECTIONS))})/n"
_STA = f"({_ph('lower(array_to_string(w,chr(32)))', W.START_PHRASES)}+{_pairs('w', _in('concat(lower(p[1]),chr(32),lower(p[2]))', W.RESTARTS))})/n"
_PAU = "(" + _rx("text", r"\.{2,}") + "+" + _lit("text", "—") + "+" + _lit("text", "–") + "+" + "+".join(_lit("lower(text)", p) for p in W.PAUSES) + ")/n"
DIS_SQL = BASE + f""", d1 AS (SELECT doc_id, n, {_FIL} AS fr, {_REP} AS rr, {_n("list_transform(w, lambda q: regexp_replace(q,'[^\\p{L}\\p{N}_\\-]','','g'))", "length(x)>=2 AND (x LIKE '%-' OR regexp_matches(x,'[bcdfghjklmnpqrstvwxyz]{3}$'))")}/n AS ir, {_STA} AS sr, {_PAU} AS ur FROM t2),
 d2 AS (SELECT doc_id, n, CASE WHEN fr=0 THEN 6e-1 WHEN fr BETWEEN 1e-2 AND 8e-2 THEN 9e-1 WHEN fr>8e-2 AND fr<=12e-2 THEN 8e-1 WHEN fr>12e-2 AND fr<=18e-2 THEN 6e-1 ELSE 3e-1 END AS filler,
  CASE WHEN rr<=0 THEN 8e-1 WHEN rr<=2e-2 THEN 9e-1 WHEN rr<=5e-2 THEN 8e-1 WHEN rr<=1e-1 THEN 6e-1 ELSE 3e-1 END AS repetition,
  CASE WHEN ir<=0 THEN 9e-1 WHEN ir<=2e-2 THEN 8e-1 WHEN ir<=5e-2 THEN 6e-1 ELSE 3e-1 END AS incomplete, CASE WHEN sr<=0 THEN 9e-1 WHEN sr<=3e-2 THEN 8e-1 WHEN sr<=6e-2 THEN 7e-1 ELSE 5e-1 END AS false_start,
  CASE WHEN ur<=0 THEN 9e-1 WHEN ur<=2e-2 THEN 8e-1 WHEN ur<=5e-2 THEN 7e-1 ELSE 5e-1 END AS pause FROM d1)"""
DIS_COLS = ["filler", "repetition", "incomplete", "false_start", "pause"]


@query("H8_score_disfluency", DIS_SQL + f""" SELECT doc_id, {_rounded(DIS_COLS)}, round(CASE WHEN n<5 THEN 7e-1 ELSE least(1,greatest(0,3e-1*filler+25e-2*repetition+2e-1*incomplete+15e-2*false_start+1e-1*pause)) END,6) AS l_disfluency FROM d2""")
def _(v):
    return _show(op.score_disfluency(v.norm), [*DIS_COLS, "l_disfluency"])
