"""Agreement between hypotheses of one unit: n-gram consensus, entity consensus and topic coherence parts."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from chorale.functions.text import NOT_WORD
from chorale.operators.skew import attach, scan_over

NGRAM_WEIGHTS = {1: 0.15, 2: 0.25, 3: 0.35, 4: 0.25}
SHORT_WORDS = ["i", "a", "to", "of", "in", "on", "at", "by", "for", "is", "are", "was", "be", "do", "no", "so", "or", "if"]


def _cleaned(c: str) -> Column:
    t = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s.?!,;:]", " ")
    words = F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) | w.isin(SHORT_WORDS))


def ngrams(hyps: DataFrame, keys: list[str], engine: str = "engine") -> DataFrame:
    """Distinct n-grams (n = 1..4) of each hypothesis with count and first position; built inside the row, then combined map-side."""
    d = hyps.select(*keys, engine, _cleaned("text").alias("w"))
    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        g = F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("gram"), i.alias("at")))
        return F.when(F.size("w") >= n, g).otherwise(F.slice(g, 1, 0))

    rows = d.select(*keys, engine, F.inline(F.concat(*[grams(n) for n in NGRAM_WEIGHTS])))
    return rows.groupBy(*keys, engine, "n", "gram").agg(F.count("*").alias("c"), F.min("at").alias("first"), F.max("at").alias("last"))


#: Characters of hypotheses that a task counts at a time; one unit is never cut.
BLOCK_CHARS = 1_000_000


def _overlaps(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Row of the batch, engine, exact and IDF overlap of each hypothesis; the last column lists a unit's (engine, cleaned text)."""
    held = batch.column(batch.num_columns - 1)
    unit, flat = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy()), held.flatten()
    docs, engines = np.bincount(unit, minlength=len(held)), flat.field(0)
    code = engines.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)  # an engine without a name meets nobody
    _, first, slot = np.unique(unit * (len(unit) + 1) + code + 1, return_index=True, return_inverse=True)
    unit_of, known, slots = unit[first], code[first] >= 0, len(first)
    words = [t.split(" ") if t else [] for t in flat.field(1).fill_null("").to_pylist()]
    hyp = np.repeat(np.arange(len(words)), list(map(len, words)))
    gram = ids = pd.factorize(np.array([w for some in words for w in some], object))[0]
    at, exact, idf, met = np.arange(len(hyp)), np.zeros(slots), np.zeros(slots), np.zeros(slots, bool)
    for n, share in NGRAM_WEIGHTS.items():
        if n > 1:  # a gram is the gram before and one word more
            whole = hyp[np.minimum(at + n - 1, len(hyp) - 1)] == hyp[at]
            whole &= at + n <= len(hyp)
            at, gram = at[whole], gram[whole]
            gram = pd.factorize(gram * len(hyp) + ids[at + n - 1])[0]
        cell, c = np.unique(gram * slots + slot[hyp[at]], return_counts=True)  # by gram; the slots of a unit lie together
        own = cell % slots
        group = np.cumsum((np.diff(cell // slots, prepend=-1) != 0) | (np.diff(unit_of[own], prepend=-1) != 0)) - 1
        weight = c * np.log(docs[unit_of[own]] / np.bincount(group)[group]) if len(own) else np.zeros(0)
        size, mass = np.bincount(own, minlength=slots), np.bincount(own, weight, slots)
        # cells and slots that are `far` apart: pairs are formed of equal grams of one unit only
        pair, shared = [np.zeros(0, np.int64)], [np.zeros(0)]
        for far in range(1, int(np.bincount(group).max(initial=0))):
            same = np.flatnonzero(group[far:] == group[:-far])
            pair.append(own[same] * slots + own[same + far])
            shared.append(np.minimum(weight[same], weight[same + far]))
        pair, back = np.unique(np.concatenate(pair), return_inverse=True)
        hits, masses = np.append(np.bincount(back, minlength=len(pair)), 0), np.append(np.bincount(back, np.concatenate(shared), len(pair)), 0.0)
        sums, others = np.zeros((2, slots)), np.zeros(slots)
        for far in range(1, int(np.bincount(unit_of).max(initial=0))):
            a = np.flatnonzero((unit_of[far:] == unit_of[:-far]) & (size[far:] > 0) & (size[:-far] > 0) & known[far:] & known[:-far])
            b, place = a + far, np.searchsorted(pair, a * slots + a + far)
            place[np.append(pair, -1)[place] != a * slots + b] = len(pair)
            hit = hits[place]
            for values, total in zip((hit / np.maximum(size[a] + size[b] - hit, 1), 2 * masses[place] / np.maximum(mass[a] + mass[b], 1.0)), sums):
                total[a] += values
                total[b] += values
            others[a] += 1
            others[b] += 1
        some = others > 0
        met |= some
        exact[some] += share * sums[0][some] / others[some]
        idf[some] += share * sums[1][some] / others[some]
    kept = np.flatnonzero(met)
    return unit_of[kept], engines.take(pa.array(first[kept])), exact[kept], idf[kept]


def ngram_consensus(hyps: DataFrame, keys: list[str], engine: str = "engine") -> DataFrame:
    """Exact Jaccard and IDF-weighted overlap per hypothesis, averaged over the unit's other hypotheses and weighted over n.

    A unit's hypotheses, texts of one turn, meet in one row, so that only texts are shuffled and no n-gram; sizes of unions follow
    from sizes of the sides, so no pair of different n-grams is ever formed.
    """
    texts = hyps.select(*keys, engine, F.array_join(_cleaned("text"), " ").alias("_text"))
    for k in keys:
        texts = texts.where(F.col(k).isNotNull())
    units = texts.groupBy(*keys).agg(F.collect_list(F.struct(engine, "_text")).alias("_hyps"))
    names = [*keys, engine, "exact", "idf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(batch.num_columns - 1)
            unit = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())
            chars = np.bincount(unit, pc.utf8_length(held.flatten().field(1).fill_null("")).to_numpy(), len(held))
            block = np.cumsum(chars) // BLOCK_CHARS
            cuts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                some = batch.slice(lo, hi - lo)
                at, engines, exact, idf = _overlaps(some)
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(pa.array(at)) for k in range(len(keys))), engines, pa.array(exact), pa.array(idf)], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in hyps.select(*keys, engine).schema.fields]
    return units.mapInArrow(run, ", ".join([*fields, "exact double", "idf double"]))


# fixed values: entity kinds compared between hypotheses
ENTITY_KINDS = [
    ("person", rf"(?:^|{NOT_WORD})([A-Z][a-z]+ [A-Z][a-z]+)(?={NOT_WORD}|$)"),
    ("organisation", rf"(?:^|{NOT_WORD})([A-Z]{{2,6}})(?={NOT_WORD}|$)"),
    ("number", r"([0-9]+(?:[.,][0-9]+)*)"),
    ("proper", rf"(?:[a-z,;] )([A-Z][a-z]{{2,}})(?={NOT_WORD}|$)"),
]


def entity_consensus(hyps: DataFrame, keys: list[str], engine: str = "engine") -> DataFrame:
    """Exact Jaccard, category match and density agreement of the entities of a unit's hypotheses (.35 / .20 / .15 of the score)."""
    found = F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda e, k=k: F.struct(F.lower(e).alias("e"), F.lit(k).alias("kind"))) for k, p in ENTITY_KINDS])
    base = hyps.select(*keys, engine, F.size(F.split(F.trim("text"), r"\s+")).alias("words"), found.alias("f"))
    e = base.select(*keys, engine, F.inline("f")).groupBy(*keys, engine, "e").agg(F.min("kind").alias("kind"))
    size = base.select(*keys, engine, "words").join(e.groupBy(*keys, engine).agg(F.count("*").alias("k")), [*keys, engine], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    side = lambda i: e.select(*keys, "e", F.col(engine).alias(f"e{i}"), F.col("kind").alias(f"k{i}"))
    both = side(1).join(side(2), [*keys, "e"]).where("e1 <> e2").groupBy(*keys, "e1", "e2").agg(F.count("*").alias("shared"), F.count(F.when(F.col("k1") == F.col("k2"), 1)).alias("same"))
    s = lambda i: size.select(*keys, F.col(engine).alias(f"e{i}"), F.col("k").alias(f"n{i}"), (F.col("k") / F.greatest("words", F.lit(1))).alias(f"d{i}"))
    p = s(1).join(s(2), keys).where("e1 <> e2").join(both, [*keys, "e1", "e2"], "left")
    hit = F.coalesce("shared", F.lit(0))
    none = (F.col("n1") == 0) & (F.col("n2") == 0)
    exact = F.when(none, 1.0).otherwise(hit / F.greatest(F.col("n1") + F.col("n2") - hit, F.lit(1)))
    kind = F.when(hit > 0, F.col("same") / F.greatest(hit, F.lit(1))).otherwise(0.0)
    density = F.when(F.greatest("d1", "d2") == 0, 1.0).otherwise(F.least("d1", "d2") / F.greatest("d1", "d2", F.lit(1e-12)))
    return p.groupBy(*keys, F.col("e1").alias(engine)).agg(F.avg(exact).alias("exact"), F.avg(kind).alias("category"), F.avg(density).alias("density"))


def topic_similarity(segments: DataFrame, keys: list[str], stop: list[str], width: float) -> DataFrame:
    """TF-IDF cosine of each segment with the next one of its session, on single content words.

    ``segments``: keys, id, start, text.  A sparse dot product: only words present in both segments meet.
    """
    d = scan_over(segments, keys, ["start", "id"], F.floor(F.col("start") / width), lead={"n_id": F.col("id")})
    w = segments.select(*keys, "id", F.explode(F.filter(F.split(F.lower("text"), NOT_WORD + "+"), lambda x: (F.length(x) > 1) & ~x.isin(stop))).alias("w"))
    tf = w.groupBy(*keys, "id", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*keys, "w").agg(F.count("*").alias("df")).join(segments.groupBy(*keys).agg(F.count("*").alias("docs")), keys)
    t = tf.join(df, [*keys, "w"]).withColumn("x", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)).select(*keys, "id", "w", "x")
    t = attach(t, [*keys, "id"], norm=F.sqrt(F.sum(F.col("x") * F.col("x")))).withColumn("x", F.col("x") / F.col("norm")).drop("norm")
    edge = d.where("n_id is not null").select(*keys, "id", "n_id")
    left = t.join(edge, [*keys, "id"]).select(*keys, "id", F.col("n_id"), "w", F.col("x").alias("x1"))
    right = t.select(*keys, F.col("id").alias("n_id"), "w", F.col("x").alias("x2"))
    dot = left.join(right, [*keys, "n_id", "w"]).groupBy(*keys, "id").agg(F.sum(F.col("x1") * F.col("x2")).alias("similarity"))
    return edge.join(dot, [*keys, "id"], "left").select(*keys, "id", "n_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
