"""Speaker identity over chunks and variants: similarity, assignment, drift, clustering quality, relabelling."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chorale.functions.vectors import dot, mean_vector, unit
from chorale.operators.fold import fold_sorted
from chorale.operators.skew import attach, first_by, islands, scan_over, top_n
from chorale.operators.turns import KEY


def chunk_speakers(turns: DataFrame) -> DataFrame:
    """One unit vector per (session, chunk, speaker) with mean confidence.  ``turns``: session_id, chunk, speaker, embedding, confidence."""
    k = [*KEY, "chunk", "speaker"]
    c = mean_vector(turns, k, "embedding")
    m = turns.groupBy(*k).agg(F.avg("confidence").alias("confidence"))
    return c.join(m, k).select(*k, unit("centroid").alias("vector"), "confidence")


def chunk_similarity(speakers: DataFrame) -> DataFrame:
    """Speakers of a chunk against those of the chunk before: cosine x mean confidence, clipped.

    A chunk has at most some fifteen speakers, one row each, so its pairs are bounded by the data model.
    """
    prev = speakers.select(*KEY, (F.col("chunk") + 1).alias("chunk"), F.col("speaker").alias("previous"), F.col("vector").alias("pv"), F.col("confidence").alias("pc"))
    s = dot("vector", "pv") * (F.col("confidence") + F.col("pc")) / 2
    return speakers.join(prev, [*KEY, "chunk"]).select(*KEY, "chunk", "speaker", "previous", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)).alias("similarity"))


def speaker_drift(similarity: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Mean best similarity per chunk, drift below the threshold, and a falling three-chunk trend."""
    best = similarity.groupBy(*KEY, "chunk", "speaker").agg(F.max("similarity").alias("b"))
    m = best.groupBy(*KEY, "chunk").agg(F.round(F.avg("b"), 9).alias("mean_similarity"), F.count(F.when(F.col("b") < threshold, 1)).alias("weak"))
    b = F.floor(F.col("chunk") / 10_000)
    d = scan_over(m, KEY, ["chunk"], b, lag={"m1": F.col("mean_similarity")})
    d = scan_over(d, KEY, ["chunk"], b, lag={"m2": F.col("m1")})
    drift = F.col("mean_similarity") < threshold
    base = F.when(drift, 1.0 - F.col("mean_similarity")).otherwise(0.0)
    falling = (F.col("m2") > F.col("m1")) & (F.col("m1") > F.col("mean_similarity"))
    return d.select(*KEY, "chunk", "mean_similarity", drift.alias("drift"), F.when(drift, F.col("weak")).otherwise(0).alias("drifting_speakers"),
                    F.when(falling, F.greatest(base, F.lit(0.3))).otherwise(base).alias("drift_score"))


def continuity(turns: DataFrame) -> DataFrame:
    """Chunk edges where the last and first three speakers overlap by more than .3.  ``turns``: session_id, chunk, id, speaker, start, end."""
    k = [*KEY, "chunk"]
    last = top_n(turns, k, [F.desc("end"), F.desc("id")], 3).groupBy(*k).agg(F.collect_set("speaker").alias("tail"))
    first = top_n(turns, k, [F.asc("start"), F.asc("id")], 3).groupBy(*k).agg(F.collect_set("speaker").alias("head"))
    nxt = first.withColumn("chunk", F.col("chunk") - 1)
    share = F.size(F.array_intersect("tail", "head")) / F.size(F.array_union("tail", "head"))
    return last.join(nxt, k).groupBy(*KEY).agg(F.count("*").alias("edges"), F.count(F.when(share > 0.3, 1)).alias("consistent")) \
        .withColumn("continuity", F.col("consistent") / F.col("edges"))


def assign(matrix: np.ndarray) -> list[tuple[int, int]]:
    """Best total one-to-one assignment of a small similarity matrix (augmenting paths with potentials)."""
    flip = matrix.shape[0] > matrix.shape[1]
    cost = -(matrix.T if flip else matrix)
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (cur < low[1:])
            low[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = 1 + int(np.argmin(np.where(free, low[1:], np.inf)))
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def map_speakers(similarity: DataFrame, speakers: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Global ids along the chunks of a session: best one-to-one match above the threshold keeps its id.

    Chunks are streamed in order; only the last chunk's id table is held.
    """
    rows = speakers.select(*KEY, "chunk", "speaker", F.lit(None).cast(speakers.schema["speaker"].dataType).alias("previous"), F.lit(None).cast("double").alias("similarity")) \
        .unionByName(similarity)
    kind = speakers.schema["speaker"].dataType.simpleString()

    def settle(s, out):
        names = sorted(s["names"])
        prev = sorted(s["ids"])
        got = {}
        if names and prev:
            m = np.array([[s["sim"].get((a, b), 0.0) for b in prev] for a in names])
            for i, j in assign(m):
                if m[i, j] >= threshold:
                    got[names[i]] = (s["ids"][prev[j]], float(m[i, j]))
        ids = {}
        for name in names:
            if name in got:
                ids[name] = got[name][0]
            else:
                ids[name] = s["next"]
                s["next"] += 1
            out.append((s["sid"], s["chunk"], name, ids[name], got.get(name, (0, None))[1]))
        s["ids"], s["names"], s["sim"] = ids, set(), {}

    columns = ["session_id", "chunk", "speaker", "global_id", "similarity"]

    def step(state, pdf):
        out = []
        s = state
        for sid, chunk, a, b, v in zip(*[pdf[c].tolist() for c in ("session_id", "chunk", "speaker", "previous", "similarity")]):
            if s is None:
                s = {"sid": sid, "chunk": chunk, "names": set(), "sim": {}, "ids": {}, "next": 0}
            if chunk != s["chunk"]:
                settle(s, out)
                if chunk != s["chunk"] + 1:
                    s["ids"] = {}
                s["chunk"] = chunk
            if b is None or pd.isna(b):
                s["names"].add(a)
            else:
                s["sim"][(a, b)] = v
        return s, pd.DataFrame(out, columns=columns)

    def finish(s):
        out = []
        settle(s, out)
        return pd.DataFrame(out, columns=columns)

    return fold_sorted(rows, KEY, ["chunk", "speaker"], f"session_id bigint, chunk bigint, speaker {kind}, global_id bigint, similarity double", step, finish)


def align_variant_speakers(speakers: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Speakers of later variants take the id of the most similar speaker of any earlier variant, else a new id.

    ``speakers``: session_id, variant, speaker, vector (unit).  A session holds a few variants of a few speakers.
    """
    d = speakers.select(*KEY, "variant", "speaker", "vector")
    kind = d.schema["speaker"].dataType.simpleString()

    def step(state, pdf):
        known, cur, pend, nxt = state or ([], None, [], 0)
        out = []
        for sid, var, spk, vec in zip(*[pdf[c].tolist() for c in ("session_id", "variant", "speaker", "vector")]):
            if var != cur:
                known, cur, pend = known + pend, var, []
            x = np.asarray(vec, float)
            best = max(((float(x @ k), -g) for k, g in known), default=(0.0, 0))
            if known and best[0] > threshold:
                gid, sim = -best[1], best[0]
            else:
                gid, sim, nxt = nxt, None, nxt + 1
            pend.append((x, gid))
            out.append((sid, var, spk, gid, sim))
        return (known, cur, pend, nxt), pd.DataFrame(out, columns=["session_id", "variant", "speaker", "global_id", "similarity"])

    return fold_sorted(d, KEY, ["variant", "speaker"], f"session_id bigint, variant bigint, speaker {kind}, global_id bigint, similarity double", step)


def centroids(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Cluster centroid weighted by confidence x min(duration, 30), floor .1, with spread and time consistency.

    ``turns``: keys, embedding, confidence, duration, start, end (seconds).
    """
    w = F.greatest(F.col("confidence") * F.least("duration", F.lit(30.0)), F.lit(0.1))
    c = mean_vector(turns, keys, "embedding", w)
    d = turns.join(c, keys).withColumn("distance", 1.0 - dot(unit("embedding"), unit("centroid")))
    m = d.groupBy(*keys).agg(
        F.count("*").alias("turns"), F.var_pop("distance").alias("variance"), F.avg("confidence").alias("confidence"), F.var_pop("start").alias("tv"),
        (F.max("end") - F.min("start")).alias("span"))
    steady = F.when((F.col("turns") > 1) & (F.col("span") > 0), F.greatest(F.lit(0.0), 1.0 - F.col("tv") / (F.col("span") * F.col("span")))).otherwise(1.0)
    return m.join(c, keys).select(*keys, "turns", "variance", "confidence", steady.alias("temporal_consistency"), "centroid")


def cluster_quality(turns: DataFrame, keys: list[str], cluster: str = "speaker") -> DataFrame:
    """Silhouette (cosine), Calinski-Harabasz, smallest centroid distance and small clusters, without point pairs.

    For unit vectors the summed cosine distance of a point to a cluster is ``n - x . sum``, so every point meets each
    cluster's sum once instead of each other point.
    """
    t = turns.select(*keys, "id", F.col(cluster).alias("own"), unit("embedding").alias("x"))
    size = t.groupBy(*keys, "own").agg(F.count("*").alias("n"))
    mean = mean_vector(t, [*keys, "own"], "x", name="mean").join(size, [*keys, "own"])
    other = mean.select(*keys, F.col("own").alias("c"), F.col("n").alias("cn"), F.col("mean").alias("cm"))
    d = t.join(other, keys).withColumn("s", dot("x", "cm") * F.col("cn"))
    per = d.groupBy(*keys, "id", "own").agg(
        F.max(F.when(F.col("c") == F.col("own"), F.col("cn"))).alias("n"),
        F.max(F.when(F.col("c") == F.col("own"), (F.col("cn") - F.col("s")) / F.greatest(F.col("cn") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(F.col("c") != F.col("own"), (F.col("cn") - F.col("s")) / F.col("cn"))).alias("b"))
    sil = F.when((F.col("n") == 1) | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    s = per.groupBy(*keys).agg(F.count("*").alias("turns"), F.avg(sil).alias("silhouette"))
    total = mean_vector(t, keys, "x", name="g")
    dev = mean.join(total, keys)
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda q, x: q + x)
    between = dev.groupBy(*keys).agg(F.count("*").alias("clusters"), F.sum(F.col("n") * sq("mean", "g")).alias("between"), F.count(F.when(F.col("n") < 3, 1)).alias("small"))
    within = t.join(mean.select(*keys, "own", "mean"), [*keys, "own"]).groupBy(*keys).agg(F.sum(sq("x", "mean")).alias("within"))
    m2 = mean.select(*keys, F.col("own").alias("o2"), F.col("mean").alias("m2"))
    sep = mean.join(m2, keys).where(F.col("own") < F.col("o2")).groupBy(*keys).agg(F.min(1.0 - dot(unit("mean"), unit("m2"))).alias("separation"))
    q = s.join(between, keys).join(within, keys).join(sep, keys, "left")
    ok = (F.col("clusters") > 1) & (F.col("turns") > F.col("clusters")) & (F.col("within") > 0)
    ch = F.when(ok, F.col("between") / F.greatest(F.col("clusters") - 1, F.lit(1)) / (F.col("within") / F.greatest(F.col("turns") - F.col("clusters"), F.lit(1)))).otherwise(0.0)
    return q.select(*keys, "turns", "clusters", "small", "silhouette", ch.alias("calinski_harabasz"), "separation")


def cluster_speakers(turns: DataFrame, low: int = 2, high: int = 15) -> DataFrame:
    """Ward clusters per session, their number voted by silhouette, Calinski-Harabasz and the elbow.

    ``turns``: session_id, id, embedding.  A session's speaker turns (some hundreds by the three-hour limit) are one
    group; corpus-wide grouping belongs to ``pyspark.ml`` clustering on the resulting centroids.
    """
    def ward(x: np.ndarray) -> list[tuple[int, int]]:
        n = len(x)
        c, size, alive, merges = {i: x[i] for i in range(n)}, dict.fromkeys(range(n), 1), list(range(n)), []
        while len(alive) > 1:
            cm = np.array([c[i] for i in alive])
            sz = np.array([size[i] for i in alive], float)
            d = ((cm[:, None] - cm[None]) ** 2).sum(2) * (sz[:, None] * sz[None]) / (sz[:, None] + sz[None])
            d[np.tril_indices(len(alive))] = np.inf
            i, j = np.unravel_index(int(np.argmin(d)), d.shape)
            a, b = alive[i], alive[j]
            c[a] = (c[a] * size[a] + c[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive.remove(b)
            merges.append((a, b))
        return merges

    def labels(n: int, merges: list[tuple[int, int]], k: int) -> np.ndarray:
        root = list(range(n))
        for a, b in merges[:n - k]:
            root = [a if r == b else r for r in root]
        names = {r: i for i, r in enumerate(dict.fromkeys(root))}
        return np.array([names[r] for r in root])

    def per_session(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack([np.asarray(v, float) for v in pdf["embedding"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        n = len(x)
        if n < 3:
            return pd.DataFrame({"session_id": pdf["session_id"], "id": pdf["id"], "cluster": 0, "clusters": 1})
        merges, scores = ward(x), []
        for k in range(low, min(high, n - 1) + 1):
            l = labels(n, merges, k)
            means = np.stack([x[l == c].mean(0) for c in range(k)])
            cnt = np.bincount(l, minlength=k)
            s = cnt[None] - x @ (means * cnt[:, None]).T
            own = s[np.arange(n), l] / np.maximum(cnt[l] - 1, 1)
            rest = s / cnt[None]
            rest[np.arange(n), l] = np.inf
            b = rest.min(1)
            sil = np.where(cnt[l] == 1, 0.0, (b - own) / np.maximum(np.maximum(own, b), 1e-12)).mean()
            inertia = ((x - means[l]) ** 2).sum()
            ch = (cnt * ((means - x.mean(0)) ** 2).sum(1)).sum() / (k - 1) / max(inertia / (n - k), 1e-12)
            scores.append((k, sil, ch, inertia))
        votes = [max(scores, key=lambda r: r[1])[0], max(scores, key=lambda r: r[2])[0]]
        if len(scores) > 2:
            bend = np.diff([r[3] for r in scores], 2)
            votes.append(scores[int(np.argmax(bend)) + 1][0])
        k = max(sorted(set(votes)), key=votes.count)
        return pd.DataFrame({"session_id": pdf["session_id"], "id": pdf["id"], "cluster": labels(n, merges, k), "clusters": k})

    return turns.select(*KEY, "id", "embedding").groupBy(*KEY).applyInPandas(per_session, "session_id bigint, id bigint, cluster int, clusters int")


def embedding_discontinuity(segments: DataFrame, reach: int = 5) -> DataFrame:
    """Distance of a segment to same-speaker segments within +-5 rows: ``(max - mean) / mean`` clipped to [0, 1].

    ``segments``: session_id, ordinal, speaker, embedding.  Pairs are at most ten per segment, by ordinal distance.
    """
    e = segments.select(*KEY, "speaker", "ordinal", unit("embedding").alias("x"))
    n = e.select(*KEY, "speaker", F.explode(F.sequence(F.col("ordinal") - reach, F.col("ordinal") + reach)).alias("at"), F.col("ordinal").alias("near"), F.col("x").alias("y")) \
        .where("at <> near").withColumnRenamed("at", "ordinal")
    d = e.join(n, [*KEY, "speaker", "ordinal"]).withColumn("d", 1.0 - dot("x", "y"))
    m = d.groupBy(*KEY, "ordinal").agg(F.count("*").alias("near"), F.avg("d").alias("mean"), F.max("d").alias("max"))
    score = F.when(F.round("mean", 12) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("max") - F.col("mean")) / F.col("mean")))).otherwise(0.0)
    return segments.select(*KEY, "ordinal", "speaker").join(m.select(*KEY, "ordinal", "near", score.alias("discontinuity")), [*KEY, "ordinal"], "left") \
        .select(*KEY, "ordinal", "speaker", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("discontinuity", F.lit(0.0)).alias("discontinuity"))


def speaker_blocks(segments: DataFrame) -> DataFrame:
    """Runs of one speaker with their bounds.  ``segments``: session_id, ordinal, speaker, start, end."""
    b = F.floor(F.col("ordinal") / 100_000)
    d = scan_over(segments, KEY, ["ordinal"], b, lag={"p": F.col("speaker")})
    return islands(d, KEY, ["ordinal"], b, F.col("p").isNull() | (F.col("p") != F.col("speaker")), "block").drop("p")


def detect_swaps(segments: DataFrame, clusters: DataFrame, threshold: float = 0.3, longest: float = 30.0) -> DataFrame:
    """Blocks that fit another speaker's centroid: .4 discontinuity + .3 neighbourhood change + .3 contiguity + cohesion.

    ``segments``: session_id, ordinal, speaker, start, end (seconds), embedding; ``clusters``: session_id, speaker, centroid.
    """
    blocks = speaker_blocks(segments)
    k = [*KEY, "block"]
    dis = embedding_discontinuity(segments).select(*KEY, "ordinal", "discontinuity")
    m = blocks.join(dis, [*KEY, "ordinal"]).groupBy(*k, "speaker").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("segments"), F.max("discontinuity").alias("discontinuity"),
        F.sum(F.col("end") - F.col("start")).alias("talk"))
    mean = mean_vector(blocks, k, "embedding", name="mean")
    d = m.where((F.col("discontinuity") > threshold) & (F.col("end") - F.col("start") <= longest)).join(mean, k)
    c = clusters.select(*KEY, F.col("speaker").alias("other"), unit("centroid").alias("c"))
    fit = d.join(c, KEY).withColumn("distance", F.round(1.0 - dot(unit("mean"), F.col("c")), 9))
    own = fit.where("other = speaker").select(*k, F.col("distance").alias("own_distance"))
    alt = first_by(fit.where("other <> speaker"), k, [F.col("distance"), F.col("other")], ["other", "distance"]).where("distance < 0.6")
    s = d.join(alt, k).join(own, k)
    gain = F.greatest(F.lit(0.0), F.col("own_distance") - F.col("distance"))
    change = F.least(F.lit(1.0), F.col("distance") / F.greatest("own_distance", F.lit(1e-9)))
    contiguity = F.least(F.lit(1.0), F.col("talk") / F.greatest(F.col("end") - F.col("start"), F.lit(1e-9)))
    score = F.col("discontinuity") * 0.4 + (1.0 - change) * 0.3 + contiguity * 0.3 + gain
    return s.select(*k, "speaker", F.col("other").alias("proposed"), "start", "end", "segments", "discontinuity", gain.alias("cohesion_gain"),
                    F.round(score, 9).alias("score")).where("score > 0.5")


def relabel(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Mapped names, unknown speakers keep theirs.  ``names``: session_id, speaker, name."""
    return segments.join(names, [*KEY, "speaker"], "left").withColumn("speaker", F.coalesce("name", F.col("speaker").cast("string"))).drop("name")


def speaker_roles(segments: DataFrame) -> DataFrame:
    """Names by talk time (``Speaker 1`` talks most) and a role by share of talk."""
    t = segments.groupBy(*KEY, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("talk"))
    t = t.withColumn("less", -F.col("talk"))
    r = scan_over(t, KEY, ["less", "speaker"], F.floor(F.col("less") / 3600), upto={"place": ("sum", F.lit(1).cast("bigint"))})
    r = attach(r, KEY, total=F.sum("talk"))
    share = F.col("talk") / F.col("total")
    return r.select(*KEY, "speaker", F.concat(F.lit("Speaker "), "place").alias("name"), share.alias("share"),
                    F.when(share >= 0.4, "primary").when(share >= 0.15, "participant").otherwise("occasional").alias("role"))
