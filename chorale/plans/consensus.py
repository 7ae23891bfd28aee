"""Selection, calibration and registry queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from chorale.dims import CALIBRATION_RANGES, CONSENSUS_WEIGHTS, DIMENSIONS, DOMAIN_FACTORS, SCORE_PRESETS
from chorale.functions.numeric import r6
from chorale.operators import calibration as cal, consensus as con
from chorale.plans.registry import query
from chorale.views import with_views


def _w(weights: dict[str, float]) -> str:
    return "(" + "+".join(f"{w!r}::DOUBLE*{d}" for d, w in weights.items()) + ")"


SCORED = with_views("cand") + f", sc AS (SELECT *, {_w(SCORE_PRESETS['default'])} AS final FROM cand)"
BEST_SQL = SCORED + """, b0 AS (SELECT *, max(final) OVER (PARTITION BY session_id) AS top FROM sc),
 b1 AS (SELECT *, max(a) OVER (PARTITION BY session_id) AS ma, count(*) OVER (PARTITION BY session_id) AS tied FROM b0 WHERE top-final < 1e-3),
 b2 AS (SELECT *, max(r) OVER (PARTITION BY session_id) AS mr FROM b1 WHERE ma-a < 1e-3),
 best AS (SELECT session_id, candidate_id, final, top AS confidence, tied FROM b2 WHERE mr-r < 1e-3
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY candidate_id)=1)"""
VOTE_SQL = """, rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY final DESC, candidate_id) AS rank,
   max(final) OVER (PARTITION BY session_id) AS best FROM sc),
 vote AS (SELECT session_id, max(CASE WHEN rank=1 THEN candidate_id END) AS candidate_id, max(final) AS final,
  sum(final*final)/sum(final) AS confidence, count(*) AS voters FROM rk
  WHERE (best >= 7e-1 AND final >= 7e-1 AND rank <= 5) OR (best < 7e-1 AND rank <= 3) GROUP BY session_id)"""
MULTI_SQL = ", ld AS (SELECT *, " + ", ".join(
    f"row_number() OVER (PARTITION BY session_id ORDER BY {d} DESC, candidate_id) AS n{d}" for d in DIMENSIONS
) + f""" FROM sc), ml AS (SELECT session_id, candidate_id, final, round(5e-1*{_w(CONSENSUS_WEIGHTS)} + 5e-1*({'+'.join(
    f"CASE WHEN n{d}=1 THEN {w!r}::DOUBLE ELSE 0e0 END" for d, w in CONSENSUS_WEIGHTS.items())}), 9) AS confidence FROM ld),
 multi AS (SELECT * FROM ml QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY confidence DESC, candidate_id)=1)"""
CONF_SQL = """, st0 AS (SELECT *, (((((0e0+d)+a)+l)+r)+o)/5 AS m FROM sc),
 st AS (SELECT *, round(m/(1e0+(((((d-m)*(d-m))+(a-m)*(a-m))+(l-m)*(l-m)+(r-m)*(r-m))+(o-m)*(o-m))/5), 9) AS stab,
  var_pop(final) OVER (PARTITION BY session_id) AS variance,
  max(final) OVER (PARTITION BY session_id) - min(final) OVER (PARTITION BY session_id) AS spread FROM st0),
 conf AS (SELECT session_id, candidate_id, final, final*(1e0-least(spread,5e-1)) AS confidence,
  CASE WHEN variance < 1e-1 THEN 'stability' ELSE 'leader' END AS reason, variance, spread FROM st
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN variance < 1e-1 THEN stab ELSE final END DESC, candidate_id)=1)"""


def scored(v):
    return con.score_candidates(v.cand)


@query("H13_score_candidates", with_views("cand") + " SELECT session_id, candidate_id, " + ", ".join(
    f"round({_w(w)},6) AS {p}" for p, w in SCORE_PRESETS.items()) + " FROM cand")
def _(v):
    return v.cand.select("session_id", "candidate_id",
                         *[r6(con.weighted(w)).alias(p) for p, w in SCORE_PRESETS.items()])


@query("F1_best_candidate", BEST_SQL + """ SELECT session_id, candidate_id, round(final,6) AS final,
 round(confidence,6) AS confidence, tied FROM best""")
def _(v):
    d = con.best_candidate(scored(v))
    return d.select("session_id", "candidate_id", r6("final").alias("final"), r6("confidence").alias("confidence"), "tied")


TWINS = SCORED + """, tw AS (SELECT session_id, candidate_id, final, a, r, CAST(supplier_id%7 AS DOUBLE) AS sw FROM sc UNION ALL SELECT session_id, concat(candidate_id,'-b'), final, a, r, CAST((supplier_id*3+1)%7 AS DOUBLE) FROM sc),
 tt AS (SELECT *, max(final) OVER (PARTITION BY session_id) AS top FROM tw QUALIFY top-final<1e-3), ta AS (SELECT *, max(a) OVER (PARTITION BY session_id) AS e FROM tt QUALIFY e-a<1e-3), tr AS (SELECT * EXCLUDE (e), max(r) OVER (PARTITION BY session_id) AS e2 FROM ta QUALIFY abs(e2-r)<1e-3),
 ts AS (SELECT *, min(sw) OVER (PARTITION BY session_id) AS e3 FROM tr QUALIFY abs(e3-sw)<1e-1), tn AS (SELECT session_id, count(*) AS tied, max(top) AS confidence FROM tt GROUP BY 1)"""


@query("F1_best_candidate_switches", TWINS + """ SELECT session_id, candidate_id, round(final,6) AS final, round(confidence,6) AS confidence, tied FROM ts JOIN tn USING (session_id) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY candidate_id)=1""")
def _(v):
    """Every candidate has a twin with the same scores, so speaker switches an hour decide."""
    d = scored(v)
    twins = d.withColumn("candidate_id", F.concat("candidate_id", F.lit("-b"))).withColumn("switches_per_hour", ((F.col("supplier_id") * 3 + 1) % 7).cast("double"))
    best = con.best_candidate(d.withColumn("switches_per_hour", (F.col("supplier_id") % 7).cast("double")).unionByName(twins))
    return best.select("session_id", "candidate_id", r6("final").alias("final"), r6("confidence").alias("confidence"), "tied")


@query("F1_best_candidate_lexical", SCORED + """ SELECT session_id, candidate_id, round(final,6) AS final,
 count(*) OVER (PARTITION BY session_id) AS tied FROM (SELECT *, max(final) OVER (PARTITION BY session_id) AS top FROM sc)
 WHERE top-final < 1e-3 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY final DESC, candidate_id)=1""")
def _(v):
    d = con.best_candidate(scored(v), "lexical")
    return d.select("session_id", "candidate_id", r6("final").alias("final"), "tied")


@query("F2_weighted_vote", SCORED + VOTE_SQL + """ SELECT session_id, candidate_id, round(final,6) AS final,
 round(confidence,6) AS confidence, voters FROM vote""")
def _(v):
    d = con.weighted_vote(scored(v))
    return d.select("session_id", "candidate_id", r6("final").alias("final"), r6("confidence").alias("confidence"), "voters")


@query("F3_multidim_consensus", SCORED + MULTI_SQL + """ SELECT session_id, candidate_id, round(final,6) AS final,
 round(confidence,6) AS confidence FROM multi""")
def _(v):
    d = con.multidim_consensus(scored(v))
    return d.select("session_id", "candidate_id", r6("final").alias("final"), r6("confidence").alias("confidence"))


@query("F4_confidence_consensus", SCORED + CONF_SQL + """ SELECT session_id, candidate_id, round(final,6) AS final,
 round(confidence,6) AS confidence, reason, round(variance,6) AS variance, round(spread,6) AS spread FROM conf""")
def _(v):
    d = con.confidence_consensus(scored(v))
    return d.select("session_id", "candidate_id", "reason", *[r6(c).alias(c) for c in ("final", "confidence", "variance", "spread")])


QUORUM_SQL = """, qm AS (SELECT session_id, count(provider) AS participants, count(DISTINCT provider) AS providers,
 count(provider) >= 3 AND count(DISTINCT provider) >= 2 AS quorum_met, greatest(3-count(provider),0) AS missing FROM cand GROUP BY 1)"""


@query("D27_quorum", with_views("cand") + QUORUM_SQL + " SELECT * FROM qm")
def _(v):
    return con.quorum(v.cand)


@query("F6_consensus", SCORED + MULTI_SQL + QUORUM_SQL + """ SELECT session_id, candidate_id, round(final,6) AS final,
 round(confidence,6) AS confidence, 'multidimensional_consensus' AS strategy FROM multi
 WHERE session_id IN (SELECT session_id FROM qm WHERE quorum_met)""")
def _(v):
    d = con.consensus(scored(v), "multidimensional_consensus")
    return d.select("session_id", "candidate_id", r6("final").alias("final"), r6("confidence").alias("confidence"), "strategy")


FOUR = ["best_single_candidate", "weighted_voting", "multidimensional_consensus", "confidence_based"]


@query("F6_compare_strategies", BEST_SQL + VOTE_SQL + MULTI_SQL + CONF_SQL + QUORUM_SQL + """, un AS (
 SELECT session_id, candidate_id FROM best UNION ALL SELECT session_id, candidate_id FROM vote
 UNION ALL SELECT session_id, candidate_id FROM multi UNION ALL SELECT session_id, candidate_id FROM conf),
 vt AS (SELECT session_id, candidate_id, count(*) AS votes FROM un
  WHERE session_id IN (SELECT session_id FROM qm WHERE quorum_met) GROUP BY ALL)
 SELECT session_id, CAST(sum(votes) AS BIGINT) AS strategies, count(*) AS winners, max(votes) AS agreeing,
 arg_min(candidate_id, (-votes, candidate_id)) AS candidate_id FROM vt GROUP BY 1""")
def _(v):
    return con.compare_strategies(scored(v), FOUR)


@query("J1_strategy_plugin", SCORED + """, p AS (SELECT * FROM sc WHERE provider='p1'
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY final DESC, candidate_id)=1)
 """ + BEST_SQL[len(SCORED):] + """ SELECT session_id, candidate_id, round(final,6) AS final, round(confidence,6) AS confidence,
  'preferred_provider' AS strategy FROM (SELECT session_id, candidate_id, final, final AS confidence FROM p) UNION ALL
 SELECT session_id, candidate_id, round(final,6), round(confidence,6), 'best_single_candidate' FROM best
 WHERE session_id NOT IN (SELECT session_id FROM p)""")
def _(v):
    def preferred(c):
        mine = c.where(F.col("provider") == "p1")
        return con.first_by(mine, ["session_id"], [-F.col("final"), F.col("candidate_id")],
                            ["candidate_id", "final", F.col("final").alias("confidence")])

    con.register_strategy("preferred_provider", preferred)
    d = con.consensus(scored(v), "preferred_provider", force=True)
    con.STRATEGIES.pop("preferred_provider")
    return d.select("session_id", "candidate_id", r6("final").alias("final"), r6("confidence").alias("confidence"), "strategy")


AUDIT_STATS = [(d, n, f) for d in DIMENSIONS for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_pop"))]


@query("D12_ensemble_audit", SCORED + """, rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY final DESC, candidate_id) AS rank FROM sc),
 t2 AS (SELECT session_id, max(CASE WHEN rank=1 THEN candidate_id END) AS winner, max(final) AS winner_score, max(final)-min(final) AS margin FROM rk WHERE rank<=2 GROUP BY 1)
 SELECT session_id, candidates, winner, round(winner_score,6) AS winner_score, round(margin,6) AS margin, round(mean_score,6) AS mean_score, round(std_score,6) AS std_score, """
       + ", ".join(f"round({d}_{n},6) AS {d}_{n}" for d, n, _ in AUDIT_STATS) + """ FROM (SELECT session_id, count(*) AS candidates, avg(final) AS mean_score, stddev_pop(final) AS std_score, """
       + ", ".join(f"{f}({d}) AS {d}_{n}" for d, n, f in AUDIT_STATS) + " FROM sc GROUP BY 1) JOIN t2 USING (session_id)")
def _(v):
    d = con.ensemble_audit(scored(v))
    return d.select(*[c if c in ("session_id", "candidates", "winner") else r6(c).alias(c) for c in d.columns])


@query("D12_top_candidates", SCORED + """ SELECT session_id, candidate_id, round(final,6) AS final,
 CAST(row_number() OVER (PARTITION BY session_id ORDER BY final DESC, candidate_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 5""")
def _(v):
    d = con.top_n(scored(v), ["session_id"], [F.desc("final"), F.asc("candidate_id")], 5)
    return d.select("session_id", "candidate_id", r6("final").alias("final"), "rank")


_STAT_WINDOW = ", ".join(
    f"{f}({d}) OVER w AS {d}_{n}" for d in DIMENSIONS
    for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


def _calibrated_sql(expr, extra="", frm="cs", places=6):
    return with_views("cand") + f", cs AS (SELECT *, count(*) OVER w AS batch, {_STAT_WINDOW} FROM cand WINDOW w AS (PARTITION BY session_id)){extra} SELECT session_id, candidate_id, " + ", ".join(
        f"round({expr(d)},{places}) AS {d}" for d in DIMENSIONS) + f" FROM {frm}"


def _abs_sql(d):
    low, high = CALIBRATION_RANGES[d]
    return f"1e0/(1e0+exp(-(6e0*(({d}-{low!r}::DOUBLE)/({high!r}::DOUBLE-{low!r}::DOUBLE)-5e-1))))"


def _show(d, places=6):
    return d.select("session_id", "candidate_id", *[(r6(x) if places == 6 else F.round(x, places)).alias(x) for x in DIMENSIONS])


@query("H14_calibrate_absolute", _calibrated_sql(_abs_sql))
def _(v):
    return _show(cal.calibrate(v.cand, "absolute"))


@query("H14_calibrate_relative", _calibrated_sql(
    lambda d: f"CASE WHEN {d}_max={d}_min THEN 5e-1 ELSE least(greatest(5e-1+8e-1*(({d}-{d}_min)/({d}_max-{d}_min)-5e-1),0),1) END"))
def _(v):
    return _show(cal.calibrate(v.cand, "relative"))


@query("H14_calibrate_logistic", _calibrated_sql(
    lambda d: f"least(greatest(1e0/(1e0+exp(-(({d}-{d}_mean)/({d}_std+1e-2)))),1e-2),99e-2)"))
def _(v):
    return _show(cal.calibrate(v.cand, "logistic"))


DOMAINS = list(DOMAIN_FACTORS)
_TARGETS = ", tg AS (SELECT " + ", ".join(f"avg({d}) AS t{d}m, greatest(stddev_samp({d}),1e-2) AS t{d}s" for d in DIMENSIONS) + " FROM cand)"


def _registry_sql(d):
    spread = f"(CASE WHEN batch>1 THEN {d}_std ELSE t{d}s END)"
    return f"""CASE WHEN {spread} > 1e-3 THEN 1e0/(1e0+exp(-least(greatest((({d}-{d}_mean)/{spread}*t{d}s+t{d}m-t{d}m)/(t{d}s*2),-10),10)))
 ELSE least(greatest(t{d}m,0),1) END"""


def contexts(v):
    sup = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")) \
        .join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    speakers = F.col("s_suppkey") % 12
    return sup.select(
        F.col("s_suppkey").alias("supplier_id"), F.col("r_name").alias("domain"),
        F.when(speakers <= 5, "2-5").when(speakers <= 10, "6-10").otherwise("11+").alias("speaker_range"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("n_nationkey") % 3 + 1).alias("noise"))


CONTEXT_SQL = """, cx AS (SELECT s_suppkey AS supplier_id, r_name AS domain, CASE WHEN s_suppkey%12<=5 THEN '2-5' WHEN s_suppkey%12<=10 THEN '6-10' ELSE '11+' END AS speaker_range,
 (['low','medium','high'])[n_nationkey%3+1] AS noise FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
 cc AS (SELECT cand.*, domain, speaker_range, noise FROM cand JOIN cx USING (supplier_id))"""


def in_context(v):
    return v.cand.join(contexts(v), "supplier_id")


@query("H14_calibrate_registry", _calibrated_sql(_registry_sql, _TARGETS, "cs, tg", 8))
def _(v):
    stats = cal.score_statistics(v.cand.select("*", *[F.lit("all").alias(c) for c in cal.CONTEXT]))
    return _show(cal.calibrate(v.cand, "registry", stats), 8)


def _domain_sql(d):
    x = f"({_abs_sql(d)}*CASE dom {' '.join(f'WHEN {i} THEN {DOMAIN_FACTORS[n][d]!r}::DOUBLE' for i, n in enumerate(DOMAINS))} END)"
    return f"CASE WHEN {x}>1 THEN 95e-2+5e-2*(1e0/(1e0+({x}-1e0))) WHEN {x}<0 THEN 5e-2*(1e0-1e0/(1e0+abs({x}))) ELSE {x} END"


@query("H14_calibrate_domain", _calibrated_sql(_domain_sql, ", cd AS (SELECT *, session_id%4 AS dom FROM cs)", "cd"))
def _(v):
    names = F.array(*[F.lit(n) for n in DOMAINS])
    d = v.cand.withColumn("domain", F.element_at(names, (F.col("session_id") % 4 + 1).cast("int")))
    return _show(cal.adjust_domain(cal.calibrate(d, "absolute")))


@query("J2_calibration_plugin", _calibrated_sql(lambda d: f"least(sqrt({d}),1e0)"))
def _(v):
    cal.register_calibration("root", lambda d: F.least(F.sqrt(F.col(d)), F.lit(1.0)))
    d = cal.calibrate(v.cand, "root")
    cal.CALIBRATIONS.pop("root")
    return _show(d)


_UNPIVOT = ", up AS (" + " UNION ALL ".join(
    f"SELECT domain, speaker_range, noise, '{d}' AS dim, {d} AS x, session_id FROM cc" for d in DIMENSIONS) + ")"


@query("D14_score_registry", with_views("cand") + CONTEXT_SQL + _UNPIVOT + """ SELECT coalesce(domain,'*') AS domain, coalesce(speaker_range,'*') AS speaker_range,
 coalesce(noise,'*') AS noise, dim, count(*) AS n, round(avg(x),6) AS mean, round(CASE WHEN count(*)>1 THEN stddev_samp(x) ELSE 1e-1 END,6) AS std, round(min(x),6) AS min, round(max(x),6) AS max
 FROM up GROUP BY GROUPING SETS ((domain,speaker_range,noise,dim),(dim))""")
def _(v):
    base = in_context(v)
    first = cal.score_statistics(base.where(F.col("session_id") % 2 == 0))
    both = cal.with_std(cal.update_registry(first, base.where(F.col("session_id") % 2 == 1)))
    return both.select(*cal.CONTEXT, "dim", "n", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("D14_registry_lookup", with_views("cand") + CONTEXT_SQL + _UNPIVOT + """, st AS (SELECT domain, speaker_range, noise, dim, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std
  FROM up GROUP BY ALL HAVING count(*) >= 3000), gl AS (SELECT dim, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std FROM up GROUP BY 1),
 ak AS (SELECT DISTINCT domain, speaker_range, noise, dim FROM cx, (SELECT DISTINCT dim FROM gl))
 SELECT ak.domain, ak.speaker_range, ak.noise, ak.dim, coalesce(st.n,gl.n) AS n, round(coalesce(st.mean,gl.mean),8) AS mean, round(coalesce(st.std,gl.std),6) AS std,
 CASE WHEN st.n IS NULL THEN 'global' ELSE 'context' END AS source FROM ak LEFT JOIN st USING (domain,speaker_range,noise,dim) JOIN gl ON gl.dim=ak.dim""")
def _(v):
    d = cal.lookup_registry(contexts(v), cal.score_statistics(in_context(v)), minimum=3000)
    return d.select(*cal.CONTEXT, "dim", "n", F.round("mean", 8).alias("mean"), r6("std").alias("std"), "source")
