"""Toxicity by a weighted finite-state pattern grammar over clauses.

Cues are learned from labelled texts: words and word stems that stand in many different contexts of toxic texts and in few of others, each with its log
odds as weight. Contexts are pairs of neighbouring words, so copies of one text count once. A short list of plain insults and threats has weights of its
own where labels say nothing of them. Five small transducers (insult, threat, target, negation, reported speech) read word classes, each
keeping its own state; composed they are one table from (state, class) to (state, factor, bonus). A clause is scored by its matched
path, from border to border whatever its length: an insult or threat counts more next to a target, less under negation or in reported speech. A document's score is a logistic function, fitted on the learning
rows, of its clause weights; clauses without a cue weigh nothing and are not read by the table.

Whole texts are read; nothing else of a row counts. Null and empty texts get the score of no match. Without toxic learning rows the plain list alone decides.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import cut_lineage, filtered
from chorale.llm.learning import fit_logistic, labelled

#: Labelled texts to learn from at most; least number of contexts, share of them in toxic texts and log-likelihood ratio of a cue.
MOST, CONTEXTS, SHARE, RATIO = 4000, 5, 0.9, 24.0
STEMS = (4, 5, 6)
REACH = 4
INSULTS = ["idiot", "moron", "stupid", "imbecile", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "dumb", "fool", "filth", "vermin", "bastard", "bitch", "asshole"]
THREATS = ["kill", "murder", "hurt", "destroy", "stab", "shoot", "strangle", "hang", "burn", "beat"]
TARGETS = ["you", "your", "yours", "yourself", "u", "ur", "he", "him", "she", "her", "they", "them", "these", "those", "people", "du", "ihr", "sie", "tu", "vous", "ils", "usted", "ustedes", "ellos", "tú"]
NEGATIONS = ["not", "no", "never", "without", "isn't", "aren't", "wasn't", "don't", "doesn't", "didn't", "won't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "ni"]
REPORTS = ["said", "says", "say", "wrote", "writes", "quoted", "quote", "called", "claimed", "reported", "allegedly", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"]
PLAIN = 1.0
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
BORDERS = ".!?;:\n\r"
BORDER = re.compile(f"[{BORDERS}]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


def countdown(kind: int, factor: float) -> tuple[int, dict]:
    """A transducer that changes what a cue is worth for `REACH` words after a word of `kind`: states REACH..0."""
    arcs = {(s, c): (REACH if c == kind else max(0, s - 1), factor if s and c in (INSULT, THREAT) else 1.0) for s in range(REACH + 1) for c in range(6)}
    return 0, arcs


def latch(kind: int, factor: float) -> tuple[int, dict]:
    """A transducer that stays in its second state once it has read a word of `kind`."""
    arcs = {(s, c): (1 if c == kind else s, factor if s and c in (INSULT, THREAT) else 1.0) for s in range(2) for c in range(6)}
    return 0, arcs


def compose(parts: list[tuple[int, dict]]) -> tuple[int, dict]:
    """The product of transducers that read the same classes: states are tuples, factors multiply. Only reachable states are kept."""
    start = tuple(s for s, _ in parts)
    numbers, arcs, waiting = {start: 0}, {}, [start]
    while waiting:
        state = waiting.pop()
        for c in range(6):
            steps = [arc[(s, c)] for s, (_, arc) in zip(state, parts, strict=True)]
            to = tuple(s for s, _ in steps)
            if to not in numbers:
                numbers[to] = len(numbers)
                waiting.append(to)
            arcs[numbers[state], c] = (numbers[to], float(np.prod([f for _, f in steps])))
    return 0, arcs


GRAMMAR = compose([latch(INSULT, 1.1), latch(THREAT, 1.1), countdown(TARGET, 1.5), countdown(NEGATION, 0.4), latch(REPORT, 0.6)])


class Model:
    """Cues with weights, and the logistic function over the sum of clause weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], line: tuple[float, float] = (-2.0, 4.0)):
        self.words = dict.fromkeys((*INSULTS, *THREATS), PLAIN) | words
        self.stems, self.line = stems, line
        self.kinds = dict.fromkeys(INSULTS, INSULT) | dict.fromkeys(THREATS, THREAT)
        self.marks = dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(REPORTS, REPORT)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "finder"}

    def ready(self):
        if "finder" not in self.__dict__:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for cue in {*self.words, *self.stems}:
                self.finder.add_word(cue, len(cue))
            self.finder.make_automaton()
        return self.finder

    def cue(self, word: str) -> float | None:
        if (w := self.words.get(word)) is not None:
            return w
        return next((self.stems[word[:n]] for n in STEMS if word[:n] in self.stems), None)

    def clause(self, text: str) -> float:
        (state, arcs), total = GRAMMAR, 0.0
        for m in WORD.finditer(text):
            word = m[0]
            weight = self.cue(word)
            kind = self.marks.get(word, OTHER) if weight is None else self.kinds.get(word, INSULT)
            state, factor = arcs[state, kind]
            if weight is not None:
                total += weight * factor
        return total

    def weigh(self, text: str) -> float:
        low = text.lower()
        total, done = 0.0, -1
        for end, n in self.ready().iter(low):
            start = end - n + 1
            if start <= done or start and low[start - 1].isalpha():
                continue
            # the whole clause around the hit, read once however many hits it has: what is searched begins behind the clause read last
            a = max(low.rfind(mark, done + 1, start) for mark in BORDERS)
            stop = BORDER.search(low, end + 1)
            b = stop.start() if stop else len(low)
            total += self.clause(low[max(a, done) + 1 : b])
            done = b
        return total

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.log1p([self.weigh(t or "") for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * x, -30, 30)))


def features(texts: list[str], labels: list[int]) -> Iterator[tuple[str, bool, str, str, int]]:
    """Word or stem, whether it is a stem, the words beside it, label; each once."""
    seen = set()
    for text, label in zip(texts, labels, strict=True):
        words = WORD.findall((text or "").lower())
        for before, word, after in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
            seen.add((word, False, before, after, label))
            for n in STEMS:
                if len(word) >= n:
                    seen.add((word[:n], True, before, after, label))
    yield from seen


def cues_of(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Learned words and stems. What comes to the driver has passed `CONTEXTS`, `SHARE` and `RATIO` on a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("label").to_pylist()
            for at in range(0, len(texts), 50):
                out = [(w, s, xxhash.xxh3_64_intdigest(f"{a} {b}") >> 1, y) for w, s, a, b, y in features(texts[at : at + 50], labels[at : at + 50])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.bool_(), pa.int64(), pa.int32()), strict=True)], names=["cue", "stem", "near", "label"])

    seen = rows.select("text", "label").mapInArrow(run, "cue string, stem boolean, near bigint, label int").distinct()
    totals = rows.groupBy("label").agg(F.count("*").alias("n")).collect()
    toxic, clean = (next((r["n"] for r in totals if r["label"] == y), 0) for y in (1, 0))
    if not toxic:
        return {}, {}
    base = toxic / (toxic + clean)
    counts = seen.groupBy("cue", "stem").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    rate = F.col("t") / F.col("n")
    ratio = 2 * (F.col("t") * F.log(rate / base) + F.when(rate < 1, (F.col("n") - F.col("t")) * F.log((1 - rate) / (1 - base))).otherwise(0.0)) if clean else F.lit(0.0)
    good = counts.where((F.col("t") >= CONTEXTS) & (rate >= SHARE) & (ratio >= RATIO)).withColumn("w", F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5) * (1 - base + 1e-9) / base) / 4)
    words, stems = {}, {}
    for r in good.collect():
        (stems if r["stem"] else words)[r["cue"]] = max(0.2, float(r["w"]))
    # a stem is kept where it says more than the words it begins: several different words
    return words, {s: w for s, w in stems.items() if s not in words}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = MOST) -> Model:
    """`learn` picks the label rows to learn from. Clause weights of at most `most` texts come to the driver."""
    rows = cut_lineage(labelled(docs, labels, "toxic", learn, most).select("text", "label"))
    model = Model(*cues_of(rows))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.weigh(t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("label")], names=["weight", "label"])

    points = sorted(rows.mapInArrow(run, "weight double, label int").collect())  # in one order, so that sums do not depend on tasks
    y = np.array([p["label"] for p in points], float)
    if 0 < y.sum() < len(y):
        model.line = fit_logistic(np.log1p([p["weight"] for p in points]), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return filtered(docs, lambda texts: (shared.value.scores(texts) < 0.5).tolist())
