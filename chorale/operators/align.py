"""Time slots over competing hypotheses: alignment, votes, confusion networks, best paths and fusion."""
from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from chorale.functions.entities import fusion_type
from chorale.functions.strings import edit_sim, seq_ratio, word_key
from chorale.operators.fold import fold_rows, fold_sorted
from chorale.operators.skew import attach, first_by, interval_join, overlap_islands, scan_over, top_n
from chorale.operators.turns import KEY, _bucket

SLOT = ["session_id", "turn", "pos"]


def align_words(words: DataFrame, width: float, unit: float = 1000.0, tol: float = 0.3, max_gap: float = 1.0) -> DataFrame:
    """Temporal slots over all candidates' words.

    A word later than everything before it by more than ``tol`` always opens a slot, so islands split a session
    exactly; inside an island the 2 s span limit depends on where the slot began and is folded in order.
    ``words``: session_id, candidate_id, word_id, start, end (+ payload).
    """
    d = overlap_islands(words, KEY, "start", "end", ["candidate_id", "word_id"], width, tol * unit)
    t, g = tol * unit, max_gap * unit

    def step(state, pdf):
        slot, lo, hi, last = state or (-1, 0, 0, 0)
        out = []
        for s, e in zip(pdf["start"].tolist(), pdf["end"].tolist()):
            if slot < 0 or s - last > g or s > hi + t or max(e, hi) - min(lo, s) > 2 * g:
                slot, lo, hi, last = slot + 1, s, e, s
            else:
                hi, last = max(hi, e), max(last, e)
            out.append(slot)
        return (slot, lo, hi, last), pdf.assign(slot=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields) + ", slot bigint"
    return fold_sorted(d, [*KEY, "island"], ["start", "candidate_id", "word_id"], fields, step)


def variants(words: DataFrame, slot: list[str] = SLOT, candidate: str = "engine") -> DataFrame:
    """Best word of each candidate in a slot.  One shuffle by slot serves every later per-slot aggregate."""
    best = Window.partitionBy(*slot, candidate).orderBy(F.desc("confidence"), F.asc_nulls_last("start_ms"), F.desc("word"))
    return words.repartition(*slot).withColumn("_r", F.row_number().over(best)).where("_r = 1") \
        .select(*slot, candidate, "word", "start_ms", "end_ms", "confidence").withColumn("key", word_key("word"))


def slot_keys(v: DataFrame, slot: list[str] = SLOT) -> DataFrame:
    """Votes per distinct word of a slot with the slot total."""
    keys = v.groupBy(*slot, "key").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    return attach(keys, slot, total=F.sum("n"))


def slot_consensus(v: DataFrame, slot: list[str] = SLOT) -> DataFrame:
    k = slot_keys(v, slot).withColumn("score", F.round(0.7 * F.col("c") / F.col("n") + 0.3 * F.col("n") / F.col("total"), 9))
    return first_by(k, slot, [-F.col("score"), F.col("key")], ["key", "score", "total"]).withColumnRenamed("key", "word")


def _quality() -> Column:
    temporal = 1.0 / (1.0 + F.sqrt(F.col("vs") + F.col("ve")))
    steady = 1.0 / (1.0 + F.col("vc"))
    agree = F.col("top") / F.col("variants")
    return F.when(F.col("variants") <= 1, 1.0).otherwise(F.least(F.lit(1.0), 0.4 * temporal + 0.3 * steady + 0.3 * agree))


def _key_counts(keys: str) -> Column:
    return F.transform(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x.eqNullSafe(k))))


def slot_quality(v: DataFrame, slot: list[str] = SLOT) -> DataFrame:
    """Spread and agreement of each slot in one pass over its variants, of which there is one a candidate."""
    sec = lambda c: F.col(c) / 1000.0
    q = v.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in slot])).groupBy(*slot).agg(
        F.count("*").alias("variants"), F.var_pop(sec("start_ms")).alias("vs"), F.var_pop(sec("end_ms")).alias("ve"),
        F.var_pop("confidence").alias("vc"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.max("confidence").alias("cmax"), F.min("confidence").alias("cmin"), F.avg("confidence").alias("cavg"),
        F.collect_list(F.struct("key")).alias("_keys"))  # a struct, so that missing words count too
    q = q.withColumn("_n", _key_counts("_keys"))
    q = q.withColumn("top", F.array_max("_n").cast("bigint")).withColumn("words", F.size("_n").cast("bigint"))
    q = q.withColumn("tied", F.size(F.filter("_n", lambda n: n == F.col("top"))).cast("bigint")).drop("_keys", "_n")
    return q.withColumn("quality", _quality())


def confusion_sets(v: DataFrame, slot: list[str] = SLOT) -> DataFrame:
    """Slots whose variants differ, with the mean block distance over pairs of variants.

    Distances are taken once per pair of distinct words and weighted by how many variants carry each.
    """
    q = slot_quality(v, slot).where("words > 1")
    k = v.groupBy(*slot, "key").agg(F.count("*").alias("n"))
    a, b = k.select(*slot, F.col("key").alias("k1"), F.col("n").alias("n1")), k.select(*slot, F.col("key").alias("k2"), F.col("n").alias("n2"))
    pairs = a.join(b, slot).where("k1 < k2")
    unique = pairs.select("k1", "k2").distinct().withColumn("dist", F.when((F.col("k1") == "") | (F.col("k2") == ""), 1.0).otherwise(
        1.0 - seq_ratio("k1", "k2")))
    far = pairs.join(unique, ["k1", "k2"]).groupBy(*slot).agg(F.sum(F.col("n1") * F.col("n2") * F.col("dist")).alias("far"))
    out = q.join(far, slot, "left")
    n = F.col("variants")
    return out.select(
        *slot, n, "words", (F.col("top") / n).alias("max_agreement"), (F.col("cmax") - F.col("cmin")).alias("confidence_spread"),
        ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("temporal_spread"), F.col("vc").alias("confidence_variance"),
        (F.coalesce("far", F.lit(0.0)) / (n * (n - 1) / 2)).alias("mean_distance"))


def resolve_confusions(v: DataFrame, slot: list[str] = SLOT, minimum: float = 0.1) -> DataFrame:
    """Weighted vote among the variants above ``minimum``, or among all where none is."""
    good = F.col("confidence") >= minimum
    k = v.groupBy(*slot, "key").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count(F.when(good, 1)).alias("gn"),
        F.sum(F.when(good, F.col("confidence"))).alias("gc"))
    k = attach(k, slot, total=F.sum("n"), gtotal=F.sum("gn"), words=F.count("*"))
    some = F.col("gtotal") > 0
    k = k.where("words > 1").where(~some | (F.col("gn") > 0))
    n, c, t = (F.when(some, F.col(a)).otherwise(F.col(b)) for a, b in (("gn", "n"), ("gc", "c"), ("gtotal", "total")))
    k = k.withColumn("score", F.round(0.7 * c / n + 0.3 * n / t, 9))
    return first_by(k, slot, [-F.col("score"), F.col("key")], ["key", "score"]).withColumnRenamed("key", "word")


def slot_votes(v: DataFrame, slot: list[str] = SLOT, minimum: float = 0.1) -> DataFrame:
    """What ``slot_quality``, ``slot_consensus`` and ``resolve_confusions`` say of a slot, and the votes for its commonest number, in one
    aggregation.  A slot holds at most one variant of each candidate, so its variants fit into an array."""
    digits = F.transform(F.regexp_extract_all("word", F.lit("([0-9]+)"), F.lit(1)), lambda d: F.regexp_replace(d, "^0+([0-9])", "$1"))
    sec = lambda c: F.col(c) / 1000.0
    q = v.groupBy(*slot).agg(
        F.count("*").alias("variants"), F.var_pop(sec("start_ms")).alias("vs"), F.var_pop(sec("end_ms")).alias("ve"), F.var_pop("confidence").alias("vc"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.avg("confidence").alias("cavg"),
        F.collect_list(F.struct("key", "confidence")).alias("_v"), F.flatten(F.collect_list(F.when(F.col("word").rlike("[0-9]"), digits))).alias("_d"))

    def counted(key: Column) -> Column:
        mine = F.filter("_v", lambda x: x["key"] == key)
        good = F.filter(mine, lambda x: x["confidence"] >= minimum)
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x["confidence"])
        return F.struct(F.size(mine).alias("n"), total(mine).alias("c"), F.size(good).alias("gn"), total(good).alias("gc"))

    q = q.withColumn("_k", F.transform(F.array_distinct(F.transform("_v", lambda x: x["key"])), counted))
    n = F.col("variants")
    q = q.withColumn("words", F.size("_k")).withColumn("top", F.array_max(F.transform("_k", lambda x: x["n"]))) \
        .withColumn("_g", F.aggregate("_k", F.lit(0), lambda acc, x: acc + x["gn"]))
    vote = lambda c, m, t: F.round(0.7 * c / m + 0.3 * m / t, 9)
    strong = F.array_max(F.transform(F.filter("_k", lambda x: x["gn"] > 0), lambda x: vote(x["gc"], x["gn"], F.col("_g"))))
    consensus = F.array_max(F.transform("_k", lambda x: vote(x["c"], x["n"], n)))
    steady = 0.4 / (1.0 + F.sqrt(F.col("vs") + F.col("ve"))) + 0.3 / (1.0 + F.col("vc")) + 0.3 * (F.col("top") / n)
    return q.select(
        *slot, "variants", "words", "top", "start_ms", "end_ms", "cavg", consensus.alias("consensus"),
        F.when(F.col("words") > 1, F.when(F.col("_g") > 0, strong).otherwise(consensus)).alias("resolved"),
        F.size(F.filter("_k", lambda x: x["n"] == F.col("top"))).alias("tied"),
        F.array_max(F.transform(F.array_distinct("_d"), lambda d: F.size(F.filter("_d", lambda x: x == d)))).alias("number_votes"),
        F.when(n <= 1, 1.0).otherwise(F.least(F.lit(1.0), steady)).alias("quality"))


def alignment_metrics(v: DataFrame, keys: list[str], slot: list[str] = SLOT) -> DataFrame:
    """Per session: perfect slots, confusion counts and gains, oscillation, numbers, coverage, overall confidence."""
    s = slot_votes(v, slot)
    conf, spread = F.col("words") > 1, (F.col("end_ms") - F.col("start_ms")) / 1000.0
    m = s.groupBy(*keys).agg(
        F.count("*").alias("slots"), F.count(F.when(~conf, 1)).alias("perfect"), F.count(F.when(conf, 1)).alias("confusions"),
        F.count("resolved").alias("resolved"), F.avg(F.when(conf & (spread > 0), spread)).alias("spread"),
        F.avg(F.col("resolved") - F.col("cavg")).alias("gain"), F.count(F.when(conf & (F.col("tied") > 1), 1)).alias("oscillating"),
        F.count("number_votes").alias("numeric"), F.count(F.when(F.col("number_votes") >= F.col("variants") * 0.6, 1)).alias("numeric_ok"),
        F.sum(spread).alias("covered"), (F.max("end_ms") / 1000.0).alias("duration"), F.avg("quality").alias("quality"), F.avg("consensus").alias("consensus"))
    d = m
    some = F.col("confusions") > 0
    rate = F.col("resolved") / F.greatest("confusions", F.lit(1))
    d = d.withColumn("coverage", F.when(F.col("duration") > 0, F.col("covered") / F.col("duration")).otherwise(0.0)) \
        .withColumn("effectiveness", F.when(some, (rate + F.col("quality") + F.col("consensus")) / 3)
                    .otherwise((F.col("quality") + F.col("consensus")) / 2))
    overall = 0.3 * F.col("quality") + 0.25 * F.col("consensus") + 0.2 * F.col("effectiveness") + 0.15 * F.col("coverage") \
        + 0.1 * F.when(some, rate).otherwise(1.0)
    return d.select(
        *keys, "slots", "perfect", "confusions", "resolved", F.coalesce("spread", F.lit(0.0)).alias("spread"),
        F.coalesce("gain", F.lit(0.0)).alias("gain"),
        F.when(some, F.least(F.lit(1.0), F.col("oscillating") / F.greatest("confusions", F.lit(1)) * 0.8)).otherwise(0.0).alias("oscillation"),
        F.when(F.col("numeric") > 0, F.col("numeric_ok") / F.greatest("numeric", F.lit(1))).otherwise(1.0).alias("numeric_consistency"),
        "coverage", "effectiveness", F.least(F.lit(1.0), F.greatest(F.lit(0.0), overall)).alias("overall"))


def token_posteriors(v: DataFrame, engines: DataFrame, slot: list[str] = SLOT) -> DataFrame:
    """Calibrated confidence x engine weight x temporal coherence, normalised per slot.

    ``engines``: engine, weight, calibrated; unknown engines weigh 1 and keep their raw confidence.
    """
    d = v.join(engines, "engine", "left")  # one row per engine
    d = attach(d, slot, slot_start=F.min("start_ms"))
    cal = F.when(F.col("calibrated").isNull(), F.col("confidence")).when(
        F.col("confidence") > 0, (F.col("calibrated") + F.col("confidence")) / 2).otherwise(F.col("calibrated"))
    late = F.abs(F.col("start_ms") - F.col("slot_start")) / 1000.0
    penalty = F.when(late <= 0.15, 0.0).otherwise(F.least((late - 0.15) / 0.1 * 0.10, F.lit(0.8)))
    d = d.withColumn("penalty", penalty).withColumn("coherence", F.greatest(1.0 - F.col("penalty"), F.lit(0.2))) \
        .withColumn("mass", cal * F.coalesce("weight", F.lit(1.0)) * F.col("coherence"))
    d = attach(d, slot, slot_mass=F.sum("mass"))
    return d.withColumn("posterior", F.when(F.col("slot_mass") > 0, F.col("mass") / F.col("slot_mass")).otherwise(0.0)) \
        .withColumn("entity_type", fusion_type("word"))


def confusion_network(p: DataFrame, slot: list[str] = SLOT) -> DataFrame:
    entropy = -F.sum(F.when(F.col("posterior") > 0, F.col("posterior") * F.log2("posterior")).otherwise(0.0))
    return p.groupBy(*slot).agg(
        F.min_by(F.struct("word", "posterior"), F.struct((-F.round("posterior", 9)).alias("p"), "engine")).alias("best"),
        entropy.alias("entropy"), F.countDistinct("engine").alias("engines"), F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"), F.count("*").alias("tokens"), F.count("entity_type").alias("entities"),
        F.sum("penalty").alias("penalty"),
    ).select(*slot, F.col("best.word").alias("consensus"), F.col("best.posterior").alias("consensus_posterior"), "entropy",
             "engines", "start_ms", "end_ms", "tokens", "entities", "penalty",
             ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("spread"))


def fusion_metrics(net: DataFrame, p: DataFrame, keys: list[str]) -> DataFrame:
    m = net.groupBy(*keys).agg(
        F.count("*").alias("slots"), F.avg("entropy").alias("entropy_avg"), F.max("entropy").alias("entropy_max"),
        F.min("entropy").alias("entropy_min"), F.avg("consensus_posterior").alias("consensus_avg"),
        F.min("consensus_posterior").alias("consensus_min"), F.avg("spread").alias("spread_avg"), F.max("spread").alias("spread_max"),
        F.sum("entities").alias("entities"), (F.sum("penalty") / F.sum("tokens")).alias("penalty_avg"))
    per = p.groupBy(*keys, "engine").agg(F.avg("confidence").alias("c"))
    best = per.groupBy(*keys).agg(F.count("*").alias("engines"), F.max("c").alias("best_engine"))
    return m.join(best, keys).withColumn("gain", F.col("consensus_avg") - F.col("best_engine"))


def entity_histogram(p: DataFrame, keys: list[str]) -> DataFrame:
    return p.where("entity_type is not null").groupBy(*keys, "entity_type").agg(F.count("*").alias("n"))


def mbr_path(p: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Best token path of each fused segment: posteriors of equal tokens add up, entities x1.2, coherence +.10,
    consistent neighbours +.15.

    A segment's slots (a few words per second of one turn) form one array; the dynamic programme is an ``aggregate``
    whose state holds one best path per token of the last slot, with true back-pointers.
    """
    t = p.groupBy(*keys, position, "word").agg(
        F.sum("posterior").alias("p"), F.max("coherence").alias("k"), F.max(F.col("entity_type").isNotNull()).alias("e"))
    gain = F.col("p") * F.when(F.col("e"), 1.2).otherwise(1.0) + F.col("k") * 0.10
    t = t.withColumn("gain", gain)
    slots = t.groupBy(*keys, position).agg(F.sort_array(F.collect_list(F.struct("word", "gain", "p"))).alias("tokens"))
    line = slots.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("at"), "tokens"))).alias("line"))
    state = "array<struct<score:double,word:string,path:array<string>,mass:double>>"

    def follow(acc: Column, slot: Column) -> Column:
        def extend(x: Column) -> Column:
            def from_previous(a: Column) -> Column:
                w0, w1 = F.lower(a["word"]), F.lower(x["word"])
                broken = (w0.isin("the", "a", "an") & w1.isin("and", "or", "but")) \
                    | (a["word"].endswith(".") & ~F.substring(x["word"], 1, 1).rlike(r"\p{Lu}"))
                return F.struct(
                    F.round(a["score"] + x["gain"] + F.when(broken, 0.0).otherwise(0.15), 12).alias("score"), x["word"].alias("word"),
                    F.concat(a["path"], F.array(x["word"])).alias("path"), (a["mass"] + x["p"]).alias("mass"))

            first = F.struct(F.round(x["gain"], 12).alias("score"), x["word"].alias("word"), F.array(x["word"]).alias("path"),
                             x["p"].cast("double").alias("mass"))
            return F.when(F.size(acc) == 0, first).otherwise(F.array_max(F.transform(acc, from_previous)))

        return F.transform(slot["tokens"], extend)

    done = F.aggregate("line", F.array().cast(state), follow)
    best = line.withColumn("best", F.array_max(done)).withColumn("n", F.size("line"))
    return best.select(*keys, "n", F.col("best.path").alias("path"), F.col("best.score").alias("score"),
                       (F.col("best.score") / F.col("n")).alias("mean_score"), (F.col("best.mass") / F.col("n")).alias("path_confidence"))


def tidy_text(c: Column | str) -> Column:
    """Spaces around punctuation fixed and sentence starts in capitals."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\s+([,.!?;:])", "$1"), r"([,.!?;:])\s*", "$1 "), r"\s+", " ")
    pieces = F.regexp_extract_all(t, F.lit(r"([^.!?]+|[.!?]+)"), F.lit(1))
    fixed = F.transform(pieces, lambda s: F.when(s.rlike("^[.!?]") | (F.trim(s) == ""), s).otherwise(
        F.concat(F.upper(F.substring(F.trim(s), 1, 1)), F.substr(F.trim(s), F.lit(2)))))
    return F.trim(F.array_join(fixed, ""))


def fused_segments(chosen: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Segments from chosen words: keys, position, word, confidence, start_ms, end_ms."""
    text = F.sort_array(F.collect_list(F.struct(position, "word")))  # the words of one segment
    return chosen.groupBy(*keys).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("words"),
        F.avg("confidence").alias("confidence"), F.array_join(text["word"], " ").alias("raw")) \
        .withColumn("text", tidy_text("raw")).drop("raw")


def alignment_consensus(v: DataFrame, candidates: DataFrame, keys: list[str], slot: list[str] = SLOT) -> DataFrame:
    """The fused words win where slots exist; other sessions keep their best candidate."""
    m = alignment_metrics(v, keys, slot)
    best = first_by(candidates, keys, [-F.col("final"), F.col("candidate_id")], ["candidate_id", "final"])
    n = candidates.groupBy(*keys).agg(F.count("*").alias("candidates"))
    d = n.join(best, keys).join(m, keys, "left")
    fused = F.col("slots").isNotNull()
    return d.select(
        *keys, F.when(fused, F.concat(F.lit("fusion_"), F.col("candidates"), F.lit("_candidates"))).otherwise(F.col("candidate_id").cast("string")).alias("winner"),
        fused.alias("fused"), F.coalesce("slots", F.lit(0)).alias("words"),
        F.when(fused, F.least(F.lit(1.0), F.col("final") + F.col("effectiveness") * 0.1)).otherwise(F.col("final")).alias("final"),
        F.coalesce("overall", "final").alias("confidence"))


def segment_decisions(v: DataFrame, candidates: DataFrame, keys: list[str], slot: list[str] = SLOT) -> DataFrame:
    """Agreement, confidence and the stop / expand decision of each segment, with its best candidate.

    ``candidates``: keys, engine, confidence, processing_time, length (characters).
    """
    engine, first = F.col("engine"), F.col("first")
    w, sec = Window.partitionBy(*slot), lambda c: F.col(c) / 1000.0  # a slot holds one row a candidate
    d = v.select(*slot, "engine", (F.row_number().over(w.orderBy("engine")) == 1).alias("first"), F.count("*").over(w).alias("variants"), F.var_pop(sec("start_ms")).over(w).alias("vs"),
                 F.var_pop(sec("end_ms")).over(w).alias("ve"), F.var_pop("confidence").over(w).alias("vc"), F.collect_list(F.struct("word")).over(w).alias("_words"))
    # most slots hold one word, whose key need not be made
    keyed = F.transform("_words", lambda x: F.struct(word_key(x["word"]).alias("key")))
    d = d.withColumn("_keys", F.when(F.size(F.array_distinct("_words")) > 1, keyed))
    d = d.withColumn("_n", F.when(F.col("_keys").isNull(), F.array(F.col("variants").cast("int"))).otherwise(_key_counts("_keys"))).withColumn("top", F.array_max("_n"))
    d = d.withColumn("quality", _quality()).withColumn("same", first & (F.size("_n") == 1))
    per = d.groupBy(*keys, "engine").agg(
        F.avg("quality").alias("temporal"), F.sum(F.when(first, F.col("quality"))).alias("q"), F.count(F.when(F.col("same"), 1)).alias("same"), F.count(F.when(first, 1)).alias("slots"))
    agreement = 0.7 * F.sum("same") / F.sum("slots") + 0.3 * (F.sum("q") / F.sum("slots"))
    s = per.groupBy(*keys).agg(agreement.alias("agreement"), F.map_from_entries(F.collect_list(F.when(engine.isNotNull(), F.struct("engine", "temporal")))).alias("heard"))
    c = attach(candidates, keys, n=F.count("*"), s1=F.sum("confidence"), s2=F.sum(F.col("confidence") * F.col("confidence")),
               var=F.var_pop("confidence"), slowest=F.max("processing_time"), avg_len=F.avg("length"))
    c = c.join(s, keys, "left").withColumn("temporal", F.try_element_at("heard", engine))
    score = 0.5 * F.col("confidence") + 0.3 * F.coalesce("temporal", F.lit(0.8)) \
        + 0.1 * F.when(F.col("slowest") > 0, 1.0 - F.col("processing_time") / F.greatest("slowest", F.lit(1e-9))).otherwise(1.0) \
        + 0.1 / (1.0 + F.abs(F.col("length") - F.col("avg_len")) / (F.col("avg_len") + 1))
    c = c.withColumn("score", F.round(score, 9))
    best = first_by(c, keys, [-F.col("score"), engine], ["engine", "score", "n", "s1", "s2", "var", "agreement"])
    d = best.withColumn("agreement", F.when(F.col("n") < 2, 1.0).otherwise(F.coalesce("agreement", F.lit(0.0))))
    d = d.withColumn("confidence", F.col("s2") / F.col("s1") / (1.0 + F.col("var")))
    decision = F.when((F.col("confidence") >= 0.92) & (F.col("agreement") >= 0.85), "stop_early") \
        .when(F.col("confidence") < 0.75, "expand_maximum").otherwise("expand_standard")
    return d.select(*keys, "engine", "score", "agreement", "confidence", decision.alias("decision"))


def duration_weighted_confidence(decisions: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    dur = F.col("end_ms") - F.col("start_ms")
    return decisions.join(spans, keys).groupBy(*KEY).agg((F.sum(dur * F.col("confidence")) / F.sum(dur)).alias("confidence"))


def reference_provider(segments: DataFrame, priors: DataFrame, unit: float, width: float) -> DataFrame:
    """Provider with the best .4 prior + .3 segment count + .3 time consistency per session.

    ``segments``: session_id, provider, id, start, end; ``priors``: provider, prior (one row per provider kind).
    """
    keys = [*KEY, "provider"]
    d = scan_over(segments, keys, ["start", "id"], _bucket("start", width), lag={"p_end": F.col("end")})
    gap = F.col("start") - F.col("p_end")
    m = d.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when((gap < -0.1 * unit) | (gap > 5.0 * unit), 1)).alias("bad"))
    m = m.join(priors, "provider", "left")
    steady = F.when(F.col("n") < 2, 1.0).otherwise(1.0 - F.col("bad") / F.greatest(F.col("n") - 1, F.lit(1)))
    score = F.coalesce("prior", F.lit(0.5)) * 0.4 + F.least(F.col("n") / 100, F.lit(1.0)) * 0.3 + steady * 0.3
    return first_by(m.withColumn("score", F.round(score, 9)), KEY, [-F.col("score"), F.col("provider")], ["provider", "score", "n"])


def provider_offsets(segments: DataFrame, reference: DataFrame, width: float, bin_ms: int = 100, reach: int = 20) -> DataFrame:
    """Clock offset of each provider against the session's reference provider.

    Start histograms are correlated only at lags within 2 s (an equi-join on the lagged bin); without a common bin
    or with fewer than three starts, the mean of the first ten start differences is used.
    ``reference``: session_id, provider.
    """
    ref_name = reference.select(*KEY, F.col("provider").alias("ref"))
    s = segments.join(ref_name, KEY)
    r, t = s.where("provider = ref"), s.where("provider <> ref")
    bins = lambda d, k: d.groupBy(*k, F.floor(F.col("start") / bin_ms).alias("bin")).agg(F.count("*").alias("n"))
    rb = bins(r, KEY).withColumnRenamed("n", "rn")
    tb = bins(t, [*KEY, "provider"]).withColumn("lag", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))) \
        .withColumn("bin", F.col("bin") + F.col("lag"))
    corr = tb.join(rb, [*KEY, "bin"]).groupBy(*KEY, "provider", "lag").agg(F.sum(F.col("n") * F.col("rn")).alias("c"))
    peak = first_by(corr, [*KEY, "provider"], [-F.col("c"), F.col("lag")], ["lag", "c"])
    counts_r = r.groupBy(*KEY).agg(F.count("*").alias("r_count"))
    counts_t = t.groupBy(*KEY, "provider").agg(F.count("*").alias("t_count"))
    ten = lambda d, k, name: top_n(d, k, [F.asc("start"), F.asc("id")], 10).select(*k, "rank", F.col("start").alias(name))
    head = ten(t, [*KEY, "provider"], "ts").join(ten(r, KEY, "rs"), [*KEY, "rank"]).groupBy(*KEY, "provider").agg(
        F.avg((F.col("rs") - F.col("ts")) / 1000.0).alias("mean_offset"))
    d = counts_t.join(counts_r, KEY).join(peak, [*KEY, "provider"], "left").join(head, [*KEY, "provider"], "left")
    by_lag = F.col("lag").isNotNull() & (F.col("t_count") >= 3) & (F.col("r_count") >= 3)
    return d.select(*KEY, "provider", by_lag.alias("by_correlation"), F.when(by_lag, -F.col("lag") * bin_ms / 1000.0)
                    .otherwise(F.coalesce("mean_offset", F.lit(0.0))).alias("offset"))


def shift_segments(segments: DataFrame, offsets: DataFrame) -> DataFrame:
    """Apply offsets (seconds) of at least 10 ms; nothing starts before 0."""
    d = segments.join(offsets.select(*KEY, "provider", "offset"), [*KEY, "provider"], "left")
    o = F.when(F.abs("offset") < 0.01, 0.0).otherwise(F.coalesce("offset", F.lit(0.0))) * 1000.0
    a = F.greatest(F.lit(0.0), F.col("start") + o)
    return d.withColumn("_a", a).withColumn("end", F.greatest(F.col("_a"), F.col("end") + o)).withColumn("start", F.col("_a")).drop("_a", "offset")


def boundary_consensus(boundaries: DataFrame, variants: DataFrame, unit: float, width: float, window: float = 0.5) -> DataFrame:
    """Boundaries within 0.5 s of the first of a group, kept when enough variants share them.

    ``boundaries``: session_id, variant, t, confidence; ``variants``: session_id, n.  Gaps over the window always end
    a group, so islands split sessions and only the anchor inside an island is folded.
    """
    d = boundaries.withColumn("t1", F.col("t"))
    d = overlap_islands(d, KEY, "t", "t1", ["variant"], width, window * unit).drop("t1")
    w = window * unit

    def close(s, rows):
        key, n, st, sc, seen = s
        rows.append((*key, st / n, sc / n, len(seen)))

    def step(state, pdf):
        anchor, acc = state or (None, None)
        rows = []
        for sid, isl, v, t, c in zip(pdf["session_id"].tolist(), pdf["island"].tolist(), pdf["variant"].tolist(), pdf["t"].tolist(), pdf["confidence"].tolist()):
            if anchor is None or t > anchor + w:
                if acc:
                    close(acc, rows)
                anchor, acc = t, [(sid,), 0, 0.0, 0.0, set()]
            acc[1] += 1
            acc[2] += t
            acc[3] += c
            acc[4].add(v)
        return (anchor, acc), pd.DataFrame(rows, columns=["session_id", "t", "confidence", "support"])

    def finish(state):
        rows = []
        if state and state[1]:
            close(state[1], rows)
        return pd.DataFrame(rows, columns=["session_id", "t", "confidence", "support"])

    found = fold_sorted(d, [*KEY, "island"], ["t", "variant"], "session_id bigint, t double, confidence double, support bigint", step, finish)
    return found.join(variants, KEY).where(F.col("support") >= F.greatest(F.lit(2), F.floor(F.col("n") * 0.6)))


def text_entropy(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Token entropy (bits) of a group's pooled texts."""
    c = texts.select(*keys, F.explode(F.split(F.trim(F.lower(text)), r"\s+")).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("c"))
    return c.groupBy(*keys).agg(F.sum("c").alias("tokens"), F.sum(F.col("c") * F.log2("c")).alias("cl")).select(
        *keys, "tokens", (F.log2("tokens") - F.col("cl") / F.col("tokens")).alias("entropy"))


def hypothesis_diversity(hyps: DataFrame, keys: list[str], engine: str = "engine") -> DataFrame:
    """Each hypothesis against the others of its unit: length, unique words, segments, confidence.

    ``hyps``: keys, engine, text, segments, confidence.  Means over the others are ``(sum - x) / (n - 1)``; a word is
    unique when a single hypothesis of the unit holds it.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zA-Z]+"), F.lit(0))
    d = hyps.withColumn("len", F.size(F.split(F.trim("text"), r"\s+")))
    d = attach(d, keys, n=F.count("*"), sl=F.sum("len"), ss=F.sum("segments"), sc=F.sum("confidence"))
    w = hyps.select(*keys, engine, F.explode(F.array_distinct(words)).alias("w"))
    held = w.groupBy(*keys, "w").agg(F.count("*").alias("holders"), F.min(engine).alias(engine))
    unique = held.where("holders = 1").groupBy(*keys, engine).agg(F.count("*").alias("unique_words"))
    size = w.groupBy(*keys, engine).agg(F.count("*").alias("vocabulary"))
    d = d.join(size, [*keys, engine], "left").join(unique, [*keys, engine], "left")
    others = F.greatest(F.col("n") - 1, F.lit(1))
    off = lambda x, s: F.least(F.lit(1.0), F.abs(F.col(x) - (F.col(s) - F.col(x)) / others) / F.greatest((F.col(s) - F.col(x)) / others, F.lit(1.0)))
    alone = F.col("n") < 2
    z = lambda c: F.when(alone, 0.0).otherwise(c)
    return d.select(
        *keys, engine, z(off("len", "sl")).alias("length_deviation"),
        z(F.coalesce("unique_words", F.lit(0)) / F.greatest(F.coalesce("vocabulary", F.lit(0)), F.lit(1))).alias("unique_share"),
        z(off("segments", "ss")).alias("segment_deviation"),
        z(F.abs(F.col("confidence") - (F.col("sc") - F.col("confidence")) / others)).alias("confidence_deviation"))


CONTEXT_RULES = [
    (["minutes", "agenda", "action"], ["meeting", "call"]),
    (["api", "database", "server"], ["system", "application", "platform"]),
    (["budget", "timeline", "resource"], ["project", "plan", "management"]),
]


def fuse_stems(words: DataFrame, glossary: DataFrame, unit: float, width: float, reach: int = 3) -> DataFrame:
    """Words of several stems in time groups (shared time >= 0.1 s); the best joint score wins its group.

    ``words``: session_id, stem, word_id, start, end, word, confidence, attribution; ``glossary``: term, prior.
    Words travel once, to their (session, time bucket).  One row per bucket carries what a bucket has to know of the others:
    the hints of the nearest ``reach`` words on each side, how far the words before it last, the number of groups before it.
    A group travels once more, as one row, because it may lie across the edge of a bucket.
    """
    part, share, low = [*KEY, "b"], 0.1 * unit, F.lower(F.trim("word"))
    row = Window.partitionBy(*part).orderBy("start", "stem", "word_id")
    upto, before = row.rowsBetween(Window.unboundedPreceding, 0), row.rowsBetween(Window.unboundedPreceding, -1)
    some = lambda c: F.coalesce(c, F.lit(0))
    d = words.select(*KEY, "stem", "word_id", "start", "end", "word", "confidence", "attribution", _bucket("start", width).alias("b"))
    mask = reduce(Column.bitwiseOR, [F.when(low.isin(hs), 1 << i).otherwise(0) for i, (_, hs) in enumerate(CONTEXT_RULES)])
    # a word shorter than 0.1 s shares too little with anything: it opens a group, and what came before it counts no more
    d = d.withColumn("hint", some(mask)).withColumn("brief", some((F.col("end") - F.col("start") < share).cast("int")))
    d = d.withColumn("rn", F.row_number().over(row)).withColumn("left", F.count("*").over(Window.partitionBy(*part)) - F.col("rn") + 1)
    d = d.withColumn("near", some(F.bit_or("hint").over(row.rowsBetween(-reach, -1))).bitwiseOR(some(F.bit_or("hint").over(row.rowsBetween(1, reach)))))
    d = d.withColumn("block", F.sum("brief").over(upto))
    d = d.withColumn("past", F.max(F.struct("block", "end")).over(before))
    d = d.withColumn("last", F.when(F.col("past.block") == F.col("block"), F.col("past.end")))
    d = d.withColumn("opens", F.col("last").isNull() | (F.col("last") < F.col("start") + share))
    d = d.withColumn("local", F.sum(F.col("opens").cast("bigint")).over(upto))

    edges = [F.max(F.when(F.col(side) == k + 1, F.col("hint"))).alias(f"{side}{k}") for side in ("rn", "left") for k in range(reach)]
    e = d.groupBy(*part).agg(F.max(F.struct("block", "end")).alias("end"), F.max("local").alias("n"), F.collect_list(
        F.when(F.col("opens") & (F.col("block") == 0), F.col("start"))).alias("starts"), *edges)
    by = Window.partitionBy(*KEY).orderBy("b")
    e = e.withColumn("blocks", F.sum("end.block").over(by))
    e = e.withColumn("lasts", F.max("end.end").over(Window.partitionBy(*KEY, "blocks").orderBy("b"))).withColumn("carried", F.lag("lasts").over(by))
    # the groups of a bucket that belong to the last one before it
    e = e.withColumn("taken", F.when(F.col("carried").isNull(), 0).otherwise(F.size(F.filter("starts", lambda x: x + share <= F.col("carried")))))
    e = e.withColumn("base", some(F.sum(F.col("n") - F.col("taken")).over(by.rowsBetween(Window.unboundedPreceding, -1))))
    beside = lambda side, step: F.slice(F.array_compact(F.array(*[
        step(f"{side}{k}", j).over(by) for j in range(1, reach + 1) for k in range(reach)])), 1, reach)
    e = e.select(*part, "taken", "base", beside("left", F.lag).alias("earlier"), beside("rn", F.lead).alias("later"))

    d = d.join(e.hint("shuffle_hash"), part)
    beyond = lambda hints, at: F.when(F.col(at) <= reach, F.aggregate(
        F.slice(hints, 1, F.lit(reach + 1) - F.col(at).cast("int")), F.lit(0), lambda a, x: a.bitwiseOR(x))).otherwise(0)
    d = d.withColumn("near", F.col("near").bitwiseOR(beyond("earlier", "rn")).bitwiseOR(beyond("later", "left")))
    d = d.withColumn("grp", F.col("base") + F.greatest(F.col("local") - F.col("taken"), F.lit(0).cast("bigint")))
    d = d.withColumn("low", low).join(glossary.select(F.lower("term").alias("low"), "prior"), "low", "left")
    apt = reduce(Column.__or__, [F.col("low").isin(ws) & (F.col("near").bitwiseAND(1 << i) != 0) for i, (ws, _) in enumerate(CONTEXT_RULES)])
    prior = F.when(F.col("low") == "", 1.0).otherwise(F.coalesce("prior", F.lit(1.0)) * F.when(apt, 1.2).otherwise(1.0))
    joint = F.col("confidence") * 0.4 + prior * 0.2 + F.col("attribution") * 0.1
    joint = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), joint)), 9)

    g = d.groupBy(*KEY, "grp").agg(F.collect_list(F.struct((-joint).alias("less"), "start", "stem", "word_id", "end", "word", "confidence")).alias("ws"))
    g = g.withColumn("win", F.array_min("ws"))
    g = g.withColumn("rest", F.filter("ws", lambda x: (x["stem"] != F.col("win.stem")) | (x["word_id"] != F.col("win.word_id"))))
    lowered = lambda w: F.lower(F.trim(w))
    top = lowered(F.col("win.word"))
    g = g.withColumn("others", F.transform("rest", lambda x: F.struct((lowered(x["word"]) == top).alias("exact"), F.when((lowered(x["word"]) == "") | (top == ""), 0.0).when(
        lowered(x["word"]) == top, 1.0).otherwise(F.greatest(F.lit(0.0), edit_sim(lowered(x["word"]), top))).alias("sim"), x["confidence"].alias("weight"))))
    k = F.size("rest")
    total = lambda f: F.aggregate("others", F.lit(0.0), lambda a, x: a + F.coalesce(f(x), F.lit(0.0)))
    many = lambda test: F.size(F.filter("others", test)) >= k * 0.7
    agree = F.when(k == 0, 0.5).when(many(lambda x: x["exact"]), 1.0).when(many(lambda x: x["sim"] >= 0.7), 1.1).otherwise(F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), total(lambda x: x["sim"] * x["weight"]) / total(lambda x: x["weight"]))))
    competing = F.transform(F.array_sort(F.transform("rest", lambda x: F.struct(x["start"], x["stem"], x["word"].alias("word")))), lambda x: x["word"])
    return g.select(
        *KEY, "grp", F.col("win.stem").alias("stem"), F.col("win.word_id").alias("word_id"), F.col("win.word").alias("word"), F.col("win.start").alias("start"),
        F.col("win.end").alias("end"), (-F.col("win.less")).alias("joint"), F.size("ws").cast("bigint").alias("size"), agree.alias("agreement"),
        F.array_join(competing, " ").alias("competing"))


def overlap_regions(words: DataFrame, regions: DataFrame, width: float) -> DataFrame:
    """Words of each region by speaker; the first two speakers heard, the better scored one primary.

    ``words``: session_id, speaker, word_id, start, end, joint; ``regions``: session_id, region_id, r0, r1.
    """
    near = interval_join(words, regions, KEY, ("start", "end"), ("r0", "r1"), width).where("start < r1 and end > r0")
    per = near.groupBy(*KEY, "region_id", "r0", "r1", "speaker").agg(
        F.count("*").alias("n"), F.sum("joint").alias("s"), F.min(F.struct("start", "word_id")).alias("first"))
    k = [*KEY, "region_id", "r0", "r1"]
    two = top_n(per, k, [F.asc("first")], 2)
    whole = per.groupBy(*k).agg(F.sum("n").alias("words"), F.count("*").alias("speakers"), (F.sum("s") / F.sum("n")).alias("confidence"))
    pick = two.groupBy(*k).agg(*[F.max(F.when(F.col("rank") == i, F.struct("speaker", (F.col("s") / F.col("n")).alias("m")))).alias(f"p{i}") for i in (1, 2)])
    swap = F.round(F.col("p2.m"), 9) > F.round(F.col("p1.m"), 9)
    return whole.where("speakers >= 2").join(pick, k).select(
        *k, "words", "speakers", "confidence", F.when(swap, F.col("p2.speaker")).otherwise(F.col("p1.speaker")).alias("primary_speaker"),
        F.when(swap, F.col("p1.speaker")).otherwise(F.col("p2.speaker")).alias("secondary_speaker"))


def attribute_stems(stems: DataFrame, keys: list[str]) -> DataFrame:
    """Most likely speaker per stem of a frame: emissions normalised, staying .2, moving .8 shared by the others.

    ``stems``: keys, stem, speakers (the frame's sorted speaker array), asr, audio, text_quality (DOUBLE) and
    consistency (one value per speaker).  At most one stem per speaker is kept, the most confident ones, so a frame's
    programme is a tiny ``aggregate`` with one state per speaker.
    """
    d = scan_over(stems.withColumn("less", -F.col("asr")), keys, ["less", "stem"], F.floor(F.col("less") * 100), upto={"r": ("sum", F.lit(1).cast("int"))})
    d = d.where(F.col("r") <= F.size("speakers"))
    raw = F.transform("consistency", lambda c: F.greatest(F.lit(0.01), F.least(
        F.lit(0.99), F.col("asr") * 0.4 + F.col("audio") * 0.3 + F.col("text_quality") * 0.2 + c * 0.1)))
    d = d.withColumn("raw", raw).withColumn("sum", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x))
    d = d.withColumn("emit", F.transform("raw", lambda e: e / F.col("sum")))
    line = d.groupBy(*keys).agg(F.max("speakers").alias("speakers"), F.sort_array(F.collect_list(F.struct("r", "stem", "emit"))).alias("line"))  # one row per speaker at most
    state = "array<struct<p:double,path:array<int>>>"

    def follow(acc: Column, x: Column) -> Column:
        def at(e: Column, s: Column) -> Column:
            def prior(a: Column, q: Column) -> Column:
                move = F.when(q == s, 0.2).otherwise(0.8 / F.greatest(F.size("speakers") - 1, F.lit(1)))
                return F.struct(F.round(a["p"] * move * e, 15).alias("p"), (-q).alias("tie"), F.concat(a["path"], F.array(s)).alias("path"))

            best = F.array_max(F.transform(acc, prior))
            first = F.struct(e.alias("p"), F.array(s).alias("path"))
            return F.when(F.size(acc) == 0, first).otherwise(F.struct(best["p"].alias("p"), best["path"].alias("path")))

        return F.transform(x["emit"], at)

    done = line.withColumn("states", F.aggregate("line", F.array().cast(state), follow))
    best = F.array_max(F.transform("states", lambda s, i: F.struct(s["p"].alias("p"), (-i).alias("tie"), s["path"].alias("path"))))
    done = done.withColumn("best", best)
    return done.select(*keys, F.col("best.p").alias("probability"), "speakers", "best", F.posexplode("line").alias("at", "x")).select(
        *keys, F.col("x.stem").alias("stem"), F.get("speakers", F.get("best.path", F.col("at"))).alias("speaker"),
        F.get("x.emit", F.get("best.path", F.col("at"))).alias("confidence"), "probability")


def chunk_features(features: DataFrame) -> DataFrame:
    """Complexity, recommended size and boundary quality of analysis windows.

    ``features``: voice_ratio, energy_variance, overlap_density, changes, silences, valleys.
    """
    one = F.lit(1.0)
    cap = lambda c: F.least(c, one)
    complexity = cap(0.25 * F.col("voice_ratio") + 0.15 * cap(F.col("energy_variance") / 100) + 0.30 * cap(F.col("overlap_density") * 2)
                     + 0.20 * cap(F.col("changes") * 0.1) + 0.10 * cap(F.col("silences") * 0.05))
    d, c = F.col("overlap_density"), F.round("complexity", 9)
    by_overlap = F.when(d >= 0.4, 0.5 + 0.3 * (1 - cap(d))).when(d <= 0.15, 1.3 + 0.5 * (1 - d)).otherwise(1.0 - 0.2 * (d - 0.15))
    by_complexity = F.when(c >= 0.7, 0.7 + 0.3 * (1 - c)).when(c <= 0.3, 1.2 + 0.3 * (1 - c)).otherwise(1.0)
    quality = cap(0.30 * cap(F.col("silences") * 0.1) + 0.25 * cap(F.col("valleys") * 0.15)
                  + 0.25 * F.greatest(F.lit(0.0), 1.0 - d) + 0.20 * cap(F.col("changes") * 0.2))
    return features.withColumn("complexity", complexity).withColumn(
        "chunk_size", F.greatest(F.lit(15.0), F.least(30.0 * by_overlap * by_complexity, F.lit(60.0)))).withColumn("boundary_quality", quality)


def plan_chunks(features: DataFrame, candidates: DataFrame, window: float = 5.0) -> DataFrame:
    """Cut times of each session: every cut aims at the size recommended where the last cut fell.

    ``features``: session_id, f0, f1 (seconds), chunk_size; ``candidates``: session_id, t, kind, base (quality before
    the distance penalty), s0 (where the pause starts, else t).  The choice is sequential, so both tables are merged
    in time order and streamed; only the candidates of the open search window are held.
    """
    kind_weight = {"pause": 0.9, "energy_valley": 1.2 * 0.7, "speaker_turn": 1.5 * 0.85}
    rows = features.select(*KEY, F.col("f0").alias("at"), F.lit(0).alias("is_candidate"), F.col("f1").alias("x"), F.col("chunk_size").alias("y"),
                           F.lit("").alias("kind")).unionByName(
        candidates.select(*KEY, F.col("s0").alias("at"), F.lit(1).alias("is_candidate"), F.col("t").alias("x"), F.col("base").alias("y"), "kind"))
    rows = attach(rows, KEY, until=F.max(F.when(F.col("is_candidate") == 0, F.col("x"))))

    class Plan:
        def __init__(self):
            self.pos, self.target, self.pool, self.sizes, self.total, self.sid = 0.0, None, [], [], 0.0, None

        def size_at(self, t):
            for a, b, s in self.sizes:
                if a <= t < b:
                    return s
            return self.sizes[-1][2] if self.sizes else 30.0

        def advance(self, now, out):
            """Settle every cut whose search window lies wholly before ``now``."""
            while self.pos < self.total:
                if self.target is None:
                    if not self.sizes:
                        return
                    self.target = self.pos + self.size_at(self.pos)
                if now <= min(self.target + window, self.total):
                    return
                hi = min(self.target + window, self.total)
                best = None
                for s0, t, base, kind in self.pool:
                    if self.target - window <= s0 <= hi:
                        q = (1.0 - abs(t - self.target) / window) * base * kind_weight[kind]
                        if best is None or round(q, 12) > round(best[0], 12):
                            best = (q, t, kind)
                cut = (best[1], best[2], best[0]) if best and best[0] > 0.3 else (min(self.target, self.total), "forced", 0.2)
                if cut[0] <= self.pos:
                    cut = (min(self.target, self.total), "forced", 0.2)
                out.append((self.sid, float(cut[0]), cut[1], float(cut[2])))
                self.pos, self.target = cut[0], None
                self.pool = [c for c in self.pool if c[0] >= self.pos]
                self.sizes = [s for s in self.sizes if s[1] > self.pos] or self.sizes[-1:]

    columns = ["session_id", "cut", "kind", "quality"]

    def step(state, pdf):
        plan = state or Plan()
        out = []
        for sid, at, cand, x, y, kind, until in zip(*[pdf[c].tolist() for c in ("session_id", "at", "is_candidate", "x", "y", "kind", "until")]):
            plan.sid, plan.total = sid, until
            plan.advance(at, out)
            if cand:
                plan.pool.append((at, x, y, kind))
            else:
                plan.sizes.append((at, x, y))
        return plan, pd.DataFrame(out, columns=columns)

    def finish(plan):
        out = []
        plan.advance(float("inf"), out)
        if out and abs(out[-1][1] - plan.total) < 0.1:
            out.pop()
        return pd.DataFrame(out, columns=columns)

    return fold_sorted(rows, KEY, ["at", "is_candidate", "kind"], "session_id bigint, cut double, kind string, quality double", step, finish)


def merge_chunks(chunks: DataFrame, tokens: DataFrame, unit: float, width: float, near: float = 0.1) -> DataFrame:
    """Overlapping neighbour chunks keep the tokens on their own side of the midpoint; equal words within 100 ms of
    one of the last three kept words are dropped.

    ``chunks``: session_id, chunk_id, start, end; ``tokens``: session_id, chunk_id, word_id, start, end, word.
    """
    c = scan_over(chunks.withColumn("id", F.col("chunk_id")), KEY, ["start", "id"], _bucket("start", width),
                  lag={"p_end": F.col("end")}, lead={"n_start": F.col("start")})
    lo = F.when(F.col("p_end") - F.col("start") > 0.01 * unit, (F.col("p_end") + F.col("start")) / 2)
    hi = F.when(F.col("end") - F.col("n_start") > 0.01 * unit, (F.col("end") + F.col("n_start")) / 2)
    edges = c.select(*KEY, "chunk_id", lo.alias("lo"), hi.alias("hi"))
    limit = near * unit
    # tokens further than 100 ms from all before them cannot be dropped because of those: the tokens of a chunk in a time bucket are one
    # piece, and pieces whose starts come within 100 ms of each other are folded together; tokens are shuffled to their edges and to the fold
    t = tokens.withColumn("piece", _bucket("start", width))
    pieces = t.groupBy(*KEY, "chunk_id", "piece").agg(F.min("start").alias("start"), F.max("start").alias("end"))
    runs = overlap_islands(pieces, KEY, "start", "end", ["chunk_id", "piece"], width, limit).select(*KEY, "chunk_id", "piece", F.col("island").alias("run"))
    t = t.join(runs.join(edges, [*KEY, "chunk_id"]), [*KEY, "chunk_id", "piece"]).where(
        (F.col("lo").isNull() | (F.col("start") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("end") <= F.col("hi"))))
    order = ["start", "chunk_id", "word_id"]

    def step(kept, s, w):
        kept = kept or []
        if w != "" and any(abs(s - k) <= limit and w == x for k, x in kept):
            return kept, False
        return (kept + [(s, w)])[-3:], True

    out = [*KEY, "chunk_id", "word_id", "start", "end", "word"]
    folded = fold_rows(t.select("run", *out), [*KEY, "run"], order, ["start", "low"], "keep boolean", step, low=F.lower(F.trim("word")))
    return folded.where("keep").select(*out)
