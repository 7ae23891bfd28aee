"""Vocabulary: token statistics, mining, the project term base, glossary bias, span verification and edit limits."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chorale.functions.strings import case_score, edit_sim, fold_accents, jaccard, plain_term, seq_ratio, technical_score, term_type, unit_score
from chorale.functions.text import bare
from chorale.operators.fold import fold_sorted
from chorale.operators.skew import attach, first_by, top_n
from chorale.operators.turns import KEY

SURE, SMOOTH, DECAY = 0.5, 0.1, 0.95


def token_stats(tokens: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``tokens``: keys, token, engine, speaker, at (BIGINT order).

    The first aggregate is a plain hash aggregate over counts and minima; sets of engine names are built from its
    much smaller result, because set and ``min_by`` aggregates over every token would have to sort.
    """
    fine = tokens.groupBy(*keys, "token", "engine", "speaker").agg(F.count("*").alias("c"), F.min("at").alias("at"))
    return fine.groupBy(*keys, "token").agg(
        F.sum("c").alias("frequency"), F.sort_array(F.collect_set("engine")).alias("engines"), F.size(F.collect_set("speaker")).cast("bigint").alias("speaker_count"),
        F.min("at").alias("first_seen")).withColumn("engine_count", F.size("engines").cast("bigint"))


def position(text_id: Column, pos: Column) -> Column:
    """Text number and token position in one ordered BIGINT."""
    return F.shiftleft(text_id.cast("bigint"), 32) + pos


def with_first_context(stats: DataFrame, texts: DataFrame, reach: int = 3, keys: list[str] = KEY) -> DataFrame:
    """Context of each token's first occurrence.  ``texts``: text_id, text.

    Texts meet the list of first occurrences they hold (at most one per distinct token), are split once, and only those
    contexts are cut out, instead of carrying a context with every token.
    """
    first = stats.select(*keys, "token", F.shiftright("first_seen", 32).alias("text_id"), F.col("first_seen").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"))
    held = first.groupBy("text_id").agg(F.collect_list(F.struct(*keys, "token", "pos")).alias("held"))
    # one element binds the split words to a lambda variable; as a plain column they would be split again per context
    both = F.array(F.struct(F.split(F.trim("text"), r"\s+").alias("w"), F.col("held").alias("h")))
    cut = F.flatten(F.transform(both, lambda z: F.transform(z["h"], lambda h: F.struct(
        *[h[k].alias(k) for k in keys], h["token"].alias("token"), F.slice(
            z["w"], F.greatest(h["pos"] - reach + 1, F.lit(1)), F.lit(reach + 1) + F.least(h["pos"], F.lit(reach))).alias("first_context")))))
    d = texts.join(held, "text_id")
    return stats.join(d.select(F.inline(cut)), [*keys, "token"])


def filter_terms(stats: DataFrame, deny: DataFrame, min_frequency: int = 2) -> DataFrame:
    """Length 2..50, minimum frequency, no listed words, bare integers only as years 1900..2100.

    ``deny``: token (lower case).  The list grows with the vocabulary, so the anti join is left to the optimiser.
    """
    n = F.length("token")
    number = F.col("token").rlike("^[0-9]+$")
    year = F.col("token").rlike("^0*(19[0-9]{2}|20[0-9]{2}|2100)$")
    d = stats.where((n >= 2) & (n <= 50) & (F.col("frequency") >= min_frequency) & (~number | year))
    return d.withColumn("low", F.lower("token")).join(deny.select(F.col("token").alias("low")), "low", "left_anti").drop("low")


def mine_terms(stats: DataFrame, totals: DataFrame, background: DataFrame, sensitivity: float = 0.5, keep: int = 200,
               unknown: float = 1e-6, keys: list[str] = KEY) -> DataFrame:
    """Mining score per term; ``stats`` with its first contexts, ``totals``: keys, total; ``background``: token (lower), probability."""
    d = stats.join(totals, keys).withColumn("low", F.lower("token")).join(
        background.select(F.col("token").alias("low"), "probability"), "low", "left")
    ratio = F.col("frequency") / F.col("total") / F.coalesce("probability", F.lit(unknown))
    d = d.withColumn("frequency_score", F.least(F.lit(1.0), F.log(ratio + 1) / F.log(F.lit(100.0)))) \
        .withColumn("case_score", case_score("token")).withColumn("technical_score", technical_score("token")) \
        .withColumn("speaker_score", F.least(F.lit(1.0), F.col("speaker_count") / 3.0)).withColumn("unit_score", unit_score("token", "first_context"))
    score = F.col("frequency_score") * 0.25 + F.col("case_score") * 0.20 + F.col("technical_score") * 0.20 \
        + F.col("speaker_score") * 0.15 + F.col("unit_score") * 0.20
    d = d.withColumn("score", F.round(score, 9)).where(F.col("score") >= sensitivity).drop("low", "probability")
    return top_n(d, keys, [F.desc("score"), F.asc("token")], keep)


def cluster_variants(terms: DataFrame, threshold: float = 0.8, keys: list[str] = KEY) -> DataFrame:
    """Greedy leader clustering of the (at most 200) mined terms of a session by visual similarity.

    Only pairs that can reach the threshold are compared: 0.4 ratio + 0.3 edit + 0.3 tokens >= .8 needs a token overlap
    of at least 1/3 or, without it, cannot be reached at all, so pairs are found by an equi-join on shared tokens.
    """
    t = terms.select(*keys, "token", "score", "frequency", "engines").withColumn("p", plain_term("token"))
    t = t.withColumn("parts", F.array_distinct(F.split(F.lower("token"), r"[\s\-_]+")))
    side = lambda i: t.select(*keys, F.col("token").alias(f"t{i}"), F.col("p").alias(f"p{i}"), F.col("score").alias(f"s{i}"), F.explode("parts").alias("part"))
    pairs = side(1).join(side(2), [*keys, "part"]).where((F.col("s1") > F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("t1") < F.col("t2")))).drop("part").distinct()
    sim = seq_ratio("p1", "p2") * 0.4 + edit_sim("p1", "p2") * 0.3 + jaccard("t1", "t2") * 0.3
    close = pairs.withColumn("sim", F.round(sim, 9)).where(F.col("sim") >= threshold)
    near = close.groupBy(*keys, F.col("t2").alias("token")).agg(F.sort_array(F.collect_list(F.struct((-F.col("s1")).alias("o"), F.col("t1").alias("t")))).alias("leaders"))
    d = t.join(near, [*keys, "token"], "left").select(
        *keys, "token", "score", (-F.col("score")).alias("o"), "frequency", F.array_join("engines", ",").alias("engines"),
        F.coalesce(F.array_join("leaders.t", "\t"), F.lit("")).alias("leaders"))

    def step(state, pdf):
        heads = state or set()
        out = []
        for tok, near_ in zip(pdf["token"].tolist(), pdf["leaders"].tolist()):
            lead = next((x for x in near_.split("\t") if x in heads), None) if near_ else None
            if lead is None:
                heads.add(tok)
                lead = tok
            out.append(lead)
        return heads, pdf.assign(leader=out).drop(columns=["leaders", "o"])

    fields = [f for f in d.schema.fields if f.name not in ("leaders", "o")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", leader string"
    led = fold_sorted(d, keys, ["o", "token"], schema, step)
    engines = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.split("engines", ","))))), ",")
    return led.groupBy(*keys, "leader").agg(
        F.count("*").alias("variants"), F.sum("frequency").alias("frequency"), engines.alias("engines"), F.max("score").alias("best"),
    ).withColumn("score", F.when(F.col("variants") > 1, F.least(F.lit(1.0), F.col("best") + F.least(F.lit(0.2), F.col("variants") * 0.05))).otherwise(F.col("best"))).drop("best")


def project_terms(docs: DataFrame) -> DataFrame:
    """Terms (lower case) of a project's even and odd documents: number of documents, forms and sources, least form as canonical.

    ``docs``: project_id, doc_id, source, text.  A document gives each of its terms and forms once; counts and keys of fixed size combine
    in the map task, and sets are built from their result.  Only ids that occur in several rows need the distinct documents of a term.
    """
    repeated = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    k = ["project_id", (F.col("doc_id") % 2).alias("half")]
    forms = F.array_distinct(F.split(F.trim("text"), r"\s+"))
    d = docs.select("doc_id", *k, F.col("source").alias("engine"), F.array_sort(F.transform(forms, lambda t: F.struct(F.lower(t).alias("low"), t.alias("token")))).alias("f"))
    # the first form of a term counts its document
    first = F.zip_with("f", F.concat(F.array(F.lit(None).cast("struct<low:string,token:string>")), "f"), lambda x, p: F.when(
        x.isNotNull(), F.struct(x["token"].alias("token"), (p.isNull() | (p["low"] != x["low"])).alias("first"))))
    rows = d.select("project_id", "doc_id", "half", "engine", F.inline(F.array_compact(first)))
    new = F.lit(0) if repeated else F.count(F.when(F.col("first"), F.col("doc_id")))
    fine = rows.groupBy("project_id", "half", "token", "engine").agg(new.cast("bigint").alias("n")).select("project_id", F.lower("token").alias("term"), "half", "token", "engine", "n")
    if repeated:
        held = rows.where("first").select("project_id", F.lower("token").alias("term"), "half", "doc_id").distinct()
        none = F.lit(None).cast("string")
        fine = fine.unionByName(held.select("project_id", "term", "half", none.alias("token"), none.alias("engine"), F.when(F.col("doc_id").isNull(), 0).otherwise(1).cast("bigint").alias("n")))
    return fine.groupBy("project_id", "term", "half").agg(
        F.min("token").alias("canonical"), F.sum("n").alias("docs"), F.sort_array(F.collect_set("engine")).alias("engines"), F.sort_array(F.collect_set("token")).alias("forms"))


def merge_term_base(base: DataFrame, session: DataFrame, deny: DataFrame, minimum: float = 0.2, max_variants: int = 10) -> DataFrame:
    """One session batch merged into a project's terms; ``status`` is added, updated, decayed or removed.

    ``base``: project_id, term (lower), canonical, total, sessions, mean, variance, decay, variants, engines;
    ``session``: project_id, token, score, variants, engines (one row per token).  Denied rows come back as ``denied``.
    """
    s = session.withColumn("term", F.lower(F.trim("token"))).join(deny.select(F.col("token").alias("term"), F.lit(True).alias("listed")), "term", "left")
    s = s.withColumn("denied", F.coalesce("listed", F.lit(False)) | (F.col("term") == "") | (F.col("score") < minimum)).drop("listed")
    s = s.withColumnRenamed("variants", "new_variants").withColumnRenamed("engines", "new_engines")
    d = base.withColumn("known", F.lit(True)).join(s.withColumn("seen", F.lit(True)), ["project_id", "term"], "full_outer")
    known, good = F.coalesce("known", F.lit(False)), F.coalesce("seen", F.lit(False)) & ~F.coalesce("denied", F.lit(True))
    seen = F.coalesce("seen", F.lit(False))
    decayed = F.when(seen, F.col("decay")).otherwise(F.col("decay") * DECAY)
    status = F.when(known & good, "updated").when(good, "added").when(~known, "denied") \
        .when(seen, "kept").when(F.round(decayed, 12) < 0.1, "removed").otherwise("decayed")
    diff = F.col("score") - F.col("mean")
    pick = lambda u, a, o: F.when(known & good, u).when(good, a).otherwise(o)
    room = F.greatest(F.lit(0), F.lit(max_variants) - F.size("variants"))
    grown = F.sort_array(F.concat("variants", F.slice(F.sort_array(F.array_except("new_variants", "variants")), F.lit(1), room)))
    return d.select(
        "project_id", "term", F.coalesce("canonical", "token").alias("canonical"), status.alias("status"),
        pick(F.col("total") + 1, F.lit(1), F.col("total")).alias("total"), pick(F.col("sessions") + 1, F.lit(1), F.col("sessions")).alias("sessions"),
        pick((1 - SMOOTH) * F.col("mean") + SMOOTH * F.col("score"), F.col("score"), F.col("mean")).alias("mean"),
        pick((1 - SMOOTH) * F.col("variance") + SMOOTH * diff * diff, F.lit(0.0), F.col("variance")).alias("variance"),
        pick(F.lit(1.0), F.lit(1.0), decayed).alias("decay"),
        pick(grown, F.sort_array("new_variants"), F.col("variants")).alias("variants"),
        pick(F.sort_array(F.array_union("engines", "new_engines")), F.sort_array("new_engines"), F.col("engines")).alias("engines"))


def surviving(merged: DataFrame) -> DataFrame:
    return merged.where(~F.col("status").isin("denied", "removed")).drop("status")


def merge_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("project_id", "status").agg(F.count("*").alias("n"))


def term_base_stats(base: DataFrame) -> DataFrame:
    return base.groupBy("project_id").agg(
        F.count("*").alias("terms"), F.avg("mean").alias("average_confidence"), F.count(F.when(F.round("mean", 9) >= 0.8, 1)).alias("high_confidence"),
        F.count(F.when(F.size("variants") > 0, 1)).alias("with_variants"), F.avg("sessions").alias("average_sessions"), F.max("sessions").alias("max_sessions"))


def engine_distribution(base: DataFrame) -> DataFrame:
    return base.select("project_id", F.explode("engines").alias("engine")).groupBy("project_id", "engine").agg(F.count("*").alias("terms"))


def top_terms(base: DataFrame, limit: int = 50, min_confidence: float = SURE, min_sessions: int = 1) -> DataFrame:
    w = F.col("mean") * 0.4 + F.col("decay") * 0.3 + F.least(F.lit(1.0), F.col("sessions") / 10.0) * 0.3
    d = base.where((F.round("mean", 9) >= min_confidence) & (F.col("sessions") >= min_sessions) & (F.col("decay") >= 0.3))
    return top_n(d.withColumn("weight", F.round(w, 9)), ["project_id"], [F.desc("weight"), F.asc("term")], limit)


def bias_list(base: DataFrame, limit: int = 100, min_confidence: float = SURE) -> DataFrame:
    return top_terms(base, limit, min_confidence).select(
        "project_id", "term", "canonical", "variants", "engines", "weight", "decay", "sessions", term_type("canonical").alias("term_type"))


def glossary_weight(terms: DataFrame, session: DataFrame, base: DataFrame) -> DataFrame:
    """Session weight first, else mean * min(1, sessions / 5), else 0.  ``terms``: project_id, term."""
    s = session.select("project_id", F.lower("token").alias("term"), F.col("score").alias("session_weight"))
    b = base.select("project_id", "term", (F.col("mean") * F.least(F.lit(1.0), F.col("sessions") / 5.0)).alias("base_weight"))
    return terms.join(s, ["project_id", "term"], "left").join(b, ["project_id", "term"], "left").select(
        "project_id", "term", F.coalesce("session_weight", "base_weight", F.lit(0.0)).alias("weight"))


def apply_glossary_bias(tokens: DataFrame, glossary: DataFrame, strength: float = 1.0, exact: float = 0.10, variant: float = 0.05, cap: float = 0.15) -> DataFrame:
    """Posterior lift for known terms: exact form first, else the heaviest term listing the token as a variant.

    ``tokens``: token, engine, posterior (+ payload); ``glossary``: term, weight, decay, variants, engines.
    """
    g = glossary.select(F.col("term").alias("low"), F.col("term").alias("e_term"), (F.col("weight") * F.col("decay")).alias("e_bias"), F.col("engines").alias("e_engines"))
    vs = glossary.select(F.explode("variants").alias("v"), "term", "weight", "decay", "engines").groupBy(F.lower("v").alias("low")).agg(
        F.min_by(F.struct("term", (F.col("weight") * F.col("decay")).alias("bias"), "engines"), F.struct((-F.col("weight")).alias("w"), "term")).alias("v"))
    d = tokens.withColumn("low", F.lower("token")).join(g, "low", "left").join(vs, "low", "left")
    hit = F.col("e_term").isNotNull()
    lift = F.when(hit, F.least(F.lit(cap), F.col("e_bias") * exact)).when(  # least() would skip a null
        F.col("v").isNotNull(), F.least(F.lit(cap), F.col("v.bias") * variant))
    known = F.when(hit, F.array_contains("e_engines", F.col("engine"))).otherwise(F.array_contains("v.engines", F.col("engine")))
    lift = F.coalesce(lift * F.when(F.coalesce(known, F.lit(False)), 1.2).otherwise(1.0), F.lit(0.0))
    new = F.least(F.lit(1.0), F.col("posterior") + lift)
    return d.select(*tokens.columns, F.coalesce("e_term", F.col("v.term")).alias("matched"),
                    (F.col("posterior") + (new - F.col("posterior")) * strength).alias("biased"))


def lexicon_usage(hyps: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Used priming terms, coverage and novel words per hypothesis; ``terms``: term (lower case single tokens)."""
    w = hyps.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zA-Z]{3,}"), F.lit(0)))).alias("term"))
    marked = w.join(terms.select("term").distinct().withColumn("known", F.lit(1)), "term", "left")
    m = marked.groupBy(*keys).agg(F.count("*").alias("words"), F.count("known").alias("used"))
    size = terms.agg(F.countDistinct("term").alias("size"))
    return m.crossJoin(F.broadcast(size)).select(  # one row
        *keys, "words", "used", (F.col("words") - F.col("used")).alias("novel"), (F.col("used") / F.greatest("size", F.lit(1))).alias("coverage"),
        ((F.col("used") * 2 + F.col("words") - F.col("used")) / F.greatest("words", F.lit(1))).alias("effectiveness"))


def allowed_forms(glossary: DataFrame, limit: int = 50) -> DataFrame:
    """Forms of the heaviest glossary entries.  ``glossary``: canonical, variants, weight."""
    g = glossary.orderBy(F.desc("weight"), F.asc("canonical")).limit(limit)
    return g.select(F.explode(F.concat(F.array("canonical"), "variants")).alias("text")).where("text <> ''").distinct()


def allowed_variants(spans: DataFrame, forms: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates marked allowed (observed in the session, or a glossary form) or blocked.

    Two equi-joins; the union of observed texts and forms is never spelled out per session.
    """
    seen = spans.select(*KEY, F.trim("text").alias("text")).where("text <> ''").distinct().withColumn("_seen", F.lit(True))
    known = forms.select("text").distinct().withColumn("_known", F.lit(True))
    d = candidates.withColumn("text", F.trim("text")).join(seen, [*KEY, "text"], "left").join(known, "text", "left")
    return d.withColumn("allowed", F.coalesce("_seen", "_known", F.lit(False))).drop("_seen", "_known")


def verify_spans(spans: DataFrame, current: DataFrame, glossary: DataFrame, rules: DataFrame | None = None, margin: float = 0.1, bonus: float = 0.2) -> DataFrame:
    """Votes + mean confidence + glossary bonus - acoustic penalty per text; a change needs the margin.

    ``spans``: session_id, span_id, text, confidence, acoustic; ``current``: session_id, span_id, text;
    ``glossary``: text, weight; ``rules``: text, adjustment.  Numbers change only to a form seen in the candidates.
    """
    k = [*KEY, "span_id"]
    g = spans.groupBy(*k, "text").agg(F.count("*").alias("votes"), F.avg("confidence").alias("c"), F.avg("acoustic").alias("a"))
    g = g.join(glossary, "text", "left")
    if rules is not None:
        g = g.join(rules, "text", "left")
    penalty = F.when(F.col("a") < 0.5, (0.5 - F.col("a")) * 0.3).otherwise(0.0)
    extra = F.coalesce("adjustment", F.lit(0.0)) if rules is not None else F.lit(0.0)
    g = g.withColumn("score", F.round(F.col("votes") + F.col("c") + F.coalesce("weight", F.lit(0.0)) * bonus - penalty + extra, 9))
    best = first_by(g, k, [-F.col("score"), F.col("text")], ["text", "score"])
    now = current.select(*k, F.col("text").alias("current"))
    own = g.select(*k, F.col("text").alias("current"), F.col("score").alias("current_score"))
    d = best.join(now, k, "left").join(own, [*k, "current"], "left")
    lead = F.col("score") - F.coalesce("current_score", F.lit(0.0))
    change = (F.col("text") != F.coalesce("current", F.lit(""))) & (F.round(lead, 9) >= margin)
    return d.select(*k, F.col("current"), F.when(change, F.col("text")).otherwise(F.coalesce("current", "text")).alias("verified"), "score", lead.alias("margin"), change.alias("changed"))


def constrain_edits(pairs: DataFrame, glossary: DataFrame, confidence: float = 0.7, trusted: float = 0.8) -> DataFrame:
    """Word-wise edit limits on texts of equal length.

    ``pairs``: id, original, repaired; ``glossary``: form (lower), canonical.  A known word may only become another known
    word (in its canonical form); an unknown word becomes a known one freely and an unknown one only when trusted.
    """
    d = pairs.withColumn("o", F.split(F.trim("original"), r"\s+")).withColumn("r", F.split(F.trim("repaired"), r"\s+"))
    same = d.where(F.size("o") == F.size("r"))
    words = same.select("id", F.posexplode(F.arrays_zip("o", "r")).alias("pos", "z")).select("id", "pos", F.col("z.o").alias("o"), F.col("z.r").alias("r"))
    words = words.withColumn("ok", bare(F.lower("o"))).withColumn("rk", bare(F.lower("r")))
    touched = words.where("ok <> rk")
    g = glossary.select("form", "canonical").dropDuplicates(["form"])
    t = touched.join(g.select(F.col("form").alias("ok"), F.lit(True).alias("from_known")), "ok", "left") \
        .join(g.select(F.col("form").alias("rk"), F.col("canonical").alias("to_form")), "rk", "left")
    to_known = F.col("to_form").isNotNull()
    keep = F.when(F.col("from_known"), to_known).otherwise(to_known | F.lit(confidence >= trusted))
    renamed = to_known & (F.col("to_form") != F.col("rk"))
    final = F.when(~keep, F.col("o")).when(renamed, F.regexp_replace("r", r"^([^\p{L}\p{N}_]*)[\p{L}\p{N}_]+", F.concat(F.lit("$1"), F.col("to_form")))).otherwise(F.col("r"))
    edits = t.select("id", "pos", final.alias("w"), (~keep | renamed).alias("limited"))
    plain = words.where("ok = rk").select("id", "pos", F.col("r").alias("w"), F.lit(False).alias("limited"))
    line = F.sort_array(F.collect_list(F.struct("pos", "w")))  # the words of one text
    done = edits.unionByName(plain).groupBy("id").agg(F.array_join(line["w"], " ").alias("text"), F.max("limited").alias("constrained"))
    rest = d.where(F.size("o") != F.size("r")).select("id", F.col("repaired").alias("text"), F.lit(False).alias("constrained"))
    return done.unionByName(rest)


def dialect_boost(words: DataFrame, lexicon: DataFrame, patterns: DataFrame, segment: list[str], cap: float = 0.15) -> DataFrame:
    """Dialect evidence per segment: word -> phonemes -> patterns; word boost min(.15, mean boost), confidence capped at 1.

    ``lexicon``: word (lower), phonemes; ``patterns``: pattern, boost (a short fixed list).  Patterns meet each lexicon
    entry once, never each spoken word.
    """
    hits = lexicon.crossJoin(F.broadcast(patterns)).where(F.expr("regexp_like(phonemes, pattern)"))  # fixed pattern list
    per = hits.groupBy("word").agg(F.least(F.lit(cap), F.avg("boost")).alias("boost"), F.count("*").alias("patterns"))
    w = words.withColumn("k", bare(F.lower("word"))).join(per.withColumnRenamed("word", "k"), "k", "left")
    return w.groupBy(*segment).agg(
        F.count("*").alias("words"), F.count("boost").alias("matched"), (F.coalesce(F.sum("boost"), F.lit(0.0)) / F.count("*")).alias("boost"),
        F.avg("confidence").alias("c")).withColumn("confidence", F.least(F.lit(1.0), F.col("c") + F.col("boost"))).drop("c")
