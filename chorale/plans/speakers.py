"""Speaker queries over the embedding table."""
from __future__ import annotations

from pyspark.sql import functions as F

from chorale.functions.numeric import r6
from chorale.operators import speakers as op
from chorale.plans.registry import query
from chorale.views import with_views


def turns(v):
    at = (F.col("vec_id") % 50) * 2.0
    return v.emb.select(F.floor(F.col("chunk") / 5).alias("session_id"), "chunk", F.col("vec_id").alias("id"), F.col("vec_id").alias("ordinal"), F.col("speaker").cast("bigint").alias("speaker"),
                        "embedding", "confidence", (F.col("chunk") * 100 + at).alias("start"), (F.col("chunk") * 100 + at + 1.5).alias("end"), F.lit(1.5).alias("duration"))


E = with_views("emb") + """, tu AS (SELECT CAST(floor(chunk/5e0) AS BIGINT) AS session_id, chunk, vec_id AS id, CAST(speaker AS BIGINT) AS speaker, CAST(embedding AS DOUBLE[]) AS e, confidence, chunk*100+(vec_id%50)*2e0 AS start, chunk*100+(vec_id%50)*2e0+15e-1 AS "end" FROM emb),
 un AS (SELECT *, list_transform(e, lambda x: x/sqrt(list_dot_product(e,e))) AS u FROM tu)"""


def _mean(src, keys, vec, out, w="1e0"):
    return f"""{out}_p AS (SELECT {keys}, unnest(range(1,65)) AS p, {vec} AS vv, {w} AS w FROM {src}), {out}_s AS (SELECT {keys}, p, sum(w*vv[p])/sum(w) AS m FROM {out}_p GROUP BY ALL), {out} AS (SELECT {keys}, list(m ORDER BY p) AS m FROM {out}_s GROUP BY ALL)"""


CS = E + ", " + _mean("tu", "session_id, chunk, speaker", "e", "mv") + """, cs AS (SELECT mv.session_id, mv.chunk, mv.speaker, list_transform(m, lambda x: x/sqrt(list_dot_product(m,m))) AS u, c FROM mv JOIN (SELECT session_id, chunk, speaker, avg(confidence) AS c FROM tu GROUP BY 1,2,3) q ON q.session_id=mv.session_id AND q.chunk=mv.chunk AND q.speaker=mv.speaker),
 si AS (SELECT a.session_id, a.chunk, a.speaker, b.speaker AS previous, greatest(0,least(1,list_dot_product(a.u,b.u)*(a.c+b.c)/2)) AS similarity FROM cs a JOIN cs b ON a.session_id=b.session_id AND b.chunk=a.chunk-1)"""


@query("H31_chunk_similarity", CS + " SELECT session_id, chunk, speaker, previous, round(similarity,6) AS similarity FROM si")
def _(v):
    return op.chunk_similarity(op.chunk_speakers(turns(v))).withColumn("similarity", r6("similarity"))


@query("H33_speaker_drift", CS + """, b AS (SELECT session_id, chunk, speaker, max(similarity) AS b FROM si GROUP BY 1,2,3), m AS (SELECT session_id, chunk, round(avg(b),9) AS ms, count(*) FILTER (b<6e-1) AS weak FROM b GROUP BY 1,2), l AS (SELECT *, lag(ms) OVER w AS m1, lag(ms,2) OVER w AS m2 FROM m WINDOW w AS (PARTITION BY session_id ORDER BY chunk))
 SELECT session_id, chunk, round(ms,6) AS mean_similarity, ms<6e-1 AS drift, CASE WHEN ms<6e-1 THEN weak ELSE 0 END AS drifting_speakers, round(CASE WHEN m2>m1 AND m1>ms THEN greatest(CASE WHEN ms<6e-1 THEN 1-ms ELSE 0 END,3e-1) ELSE CASE WHEN ms<6e-1 THEN 1-ms ELSE 0 END END,6) AS drift_score FROM l""")
def _(v):
    d = op.speaker_drift(op.chunk_similarity(op.chunk_speakers(turns(v))))
    return d.withColumn("mean_similarity", r6("mean_similarity")).withColumn("drift_score", r6("drift_score"))


@query("H33_continuity", E + """, a AS (SELECT session_id, chunk, speaker, row_number() OVER (PARTITION BY session_id,chunk ORDER BY "end" DESC, id DESC) AS r1, row_number() OVER (PARTITION BY session_id,chunk ORDER BY start, id) AS r2 FROM tu),
 t AS (SELECT session_id, chunk, list_distinct(list(speaker)) AS s FROM a WHERE r1<=3 GROUP BY 1,2), h AS (SELECT session_id, chunk, list_distinct(list(speaker)) AS s FROM a WHERE r2<=3 GROUP BY 1,2),
 j AS (SELECT t.session_id, len(list_intersect(t.s,h.s))/len(list_distinct(list_concat(t.s,h.s))) AS sh FROM t JOIN h ON t.session_id=h.session_id AND h.chunk=t.chunk+1) SELECT session_id, count(*) AS edges, count(*) FILTER (sh>3e-1) AS consistent, round(count(*) FILTER (sh>3e-1)/count(*),6) AS continuity FROM j GROUP BY 1""")
def _(v):
    return op.continuity(turns(v)).withColumn("continuity", r6("continuity"))


@query("H32_map_speakers")
def _(v):
    s = op.chunk_speakers(turns(v))
    return op.map_speakers(op.chunk_similarity(s), s, 0.3).withColumn("similarity", r6("similarity"))


@query("H29_align_variant_speakers")
def _(v):
    s = op.chunk_speakers(turns(v)).withColumnRenamed("chunk", "variant")
    return op.align_variant_speakers(s, 0.4).withColumn("similarity", r6("similarity"))


W = "greatest(confidence*15e-1,1e-1)"
CEN = E + ", " + _mean("tu", "session_id, speaker", "e", "ce", W) + """, cd AS (SELECT tu.*, 1-list_dot_product(e,m)/sqrt(list_dot_product(e,e)*list_dot_product(m,m)) AS dist FROM tu JOIN ce USING (session_id,speaker)),
 cq AS (SELECT session_id, speaker, count(*) AS turns, var_pop(dist) AS variance, avg(confidence) AS confidence, CASE WHEN count(*)>1 AND max("end")-min(start)>0 THEN greatest(0,1-var_pop(start)/((max("end")-min(start))*(max("end")-min(start)))) ELSE 1 END AS tc FROM cd GROUP BY 1,2)"""


@query("D21_centroids", CEN + " SELECT session_id, speaker, turns, round(variance,6) AS variance, round(confidence,6) AS confidence, round(tc,6) AS temporal_consistency, round(m[1],6) AS c1, round(list_sum(m),6) AS total FROM cq JOIN ce USING (session_id,speaker)")
def _(v):
    d = op.centroids(turns(v), ["session_id", "speaker"])
    return d.select("session_id", "speaker", "turns", *[r6(c).alias(c) for c in ("variance", "confidence", "temporal_consistency")], r6(F.col("centroid")[0]).alias("c1"),
                    r6(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("H35_cluster_quality", E + ", " + _mean("un", "session_id, speaker", "u", "cm") + ", " + _mean("un", "session_id", "u", "gm") + """, n AS (SELECT session_id, speaker, count(*) AS n FROM un GROUP BY 1,2), cn AS (SELECT cm.*, n FROM cm JOIN n USING (session_id,speaker)),
 pd AS (SELECT a.session_id, a.id, a.speaker, b.speaker AS c, sum(1-list_dot_product(a.u,b.u)) AS sd, count(*) AS k FROM un a JOIN un b ON a.session_id=b.session_id GROUP BY ALL),
 pa AS (SELECT session_id, id, max(CASE WHEN c=speaker THEN k END) AS n, max(CASE WHEN c=speaker THEN sd/greatest(k-1,1) END) AS a, min(CASE WHEN c<>speaker THEN sd/k END) AS b FROM pd GROUP BY 1,2),
 sl AS (SELECT session_id, count(*) AS turns, avg(CASE WHEN n=1 OR b IS NULL THEN 0 ELSE (b-a)/greatest(a,b) END) AS silhouette FROM pa GROUP BY 1),
 bw AS (SELECT cn.session_id, count(*) AS clusters, sum(n*list_distance(cn.m,gm.m)*list_distance(cn.m,gm.m)) AS b, count(*) FILTER (n<3) AS small FROM cn JOIN gm ON gm.session_id=cn.session_id GROUP BY 1), wi AS (SELECT un.session_id, sum(list_distance(u,m)*list_distance(u,m)) AS w FROM un JOIN cm USING (session_id,speaker) GROUP BY 1),
 sp AS (SELECT a.session_id, min(1-list_dot_product(a.m,b.m)/sqrt(list_dot_product(a.m,a.m)*list_dot_product(b.m,b.m))) AS separation FROM cm a JOIN cm b ON a.session_id=b.session_id AND a.speaker<b.speaker GROUP BY 1)
 SELECT sl.session_id, turns, clusters, small, round(silhouette,6) AS silhouette, round(CASE WHEN clusters>1 AND turns>clusters AND w>0 THEN b/(clusters-1)/(w/(turns-clusters)) ELSE 0 END,6) AS calinski_harabasz, round(separation,6) AS separation FROM sl JOIN bw USING (session_id) JOIN wi USING (session_id) LEFT JOIN sp USING (session_id)""")
def _(v):
    d = op.cluster_quality(turns(v), ["session_id"])
    return d.select("session_id", "turns", "clusters", "small", *[r6(c).alias(c) for c in ("silhouette", "calinski_harabasz", "separation")])


@query("H34_cluster_speakers")
def _(v):
    return op.cluster_speakers(turns(v))


@query("E13_embedding_discontinuity", E + """, p AS (SELECT a.session_id, a.id, count(*) AS near, avg(1-list_dot_product(a.u,b.u)) AS mean, max(1-list_dot_product(a.u,b.u)) AS mx FROM un a JOIN un b ON a.session_id=b.session_id AND a.speaker=b.speaker AND a.id<>b.id AND abs(a.id-b.id)<=5 GROUP BY 1,2)
 SELECT un.session_id, un.id AS ordinal, speaker, coalesce(near,0) AS near, round(coalesce(CASE WHEN round(mean,12)>0 THEN least(1,greatest(0,(mx-mean)/mean)) ELSE 0 END,0),6) AS discontinuity FROM un LEFT JOIN p ON p.session_id=un.session_id AND p.id=un.id""")
def _(v):
    return op.embedding_discontinuity(turns(v)).withColumn("discontinuity", r6("discontinuity"))


@query("E13_speaker_blocks", E + """, l AS (SELECT *, lag(speaker) OVER (PARTITION BY session_id ORDER BY id) AS p FROM tu) SELECT session_id, id AS ordinal, speaker, CAST(sum(CASE WHEN p IS NULL OR p<>speaker THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY id) AS BIGINT) AS block FROM l""")
def _(v):
    return op.speaker_blocks(turns(v)).select("session_id", "ordinal", "speaker", "block")


@query("H36_detect_swaps")
def _(v):
    t = turns(v)
    d = op.detect_swaps(t, op.centroids(t, ["session_id", "speaker"]), threshold=-1.0)
    return d.select("session_id", "block", "speaker", "proposed", "segments", r6("score").alias("score"))


ROLES = E + """, tk AS (SELECT session_id, speaker, sum("end"-start) AS talk FROM tu GROUP BY 1,2), ro AS (SELECT session_id, speaker, concat('Speaker ',row_number() OVER (PARTITION BY session_id ORDER BY talk DESC, speaker)) AS name, talk/sum(talk) OVER (PARTITION BY session_id) AS share FROM tk)"""


@query("H36_speaker_roles", ROLES + " SELECT session_id, speaker, name, round(share,6) AS share, CASE WHEN share>=4e-1 THEN 'primary' WHEN share>=15e-2 THEN 'participant' ELSE 'occasional' END AS role FROM ro")
def _(v):
    return op.speaker_roles(turns(v)).withColumn("share", r6("share"))


@query("H36_relabel", ROLES + " SELECT tu.session_id, tu.id, CASE WHEN tu.speaker%2=0 THEN name ELSE concat(name,' *') END AS speaker FROM tu LEFT JOIN ro ON ro.session_id=tu.session_id AND ro.speaker=tu.speaker")
def _(v):
    t = turns(v)
    names = op.speaker_roles(t).select("session_id", "speaker", F.when(F.col("speaker") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit(" *"))).alias("name"))
    return op.relabel(t, names).select("session_id", "id", "speaker")
