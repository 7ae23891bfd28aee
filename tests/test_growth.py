"""Findings of larger tables and odd sessions, on small cases."""
import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from chorale import words as words_of_lists
from chorale.functions import marks, text
from chorale.operators import agreement, align, consensus, evaluate as ev, linguistic, terms

DATA = "/root/testdata/sf0.1"


def test_calibration_of_equal_rates_is_zero(spark):
    # session 1: every rate is 0; session 2: every confidence is equal; session 3: better words are surer
    rows = [(1, 0, 0, .5, "a b", "a b"), (1, 0, 1, .7, "a b", "a b"), (2, 0, 0, .5, "a b", "a b"), (2, 0, 1, .5, "a b", "a c"),
            (3, 0, 0, .9, "a b", "a b"), (3, 0, 1, .6, "a b", "a c"), (3, 0, 2, .3, "a b", "c c")]
    d = spark.createDataFrame(rows, "session_id long, turn long, engine long, confidence double, ref string, hyp string")
    got = {r.session_id: r.calibration for r in ev.ensemble_metrics(d, ["session_id", "turn"]).collect()}
    assert got[1] == got[2] == 0 and got[3] == pytest.approx(1)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the table of conversations at sf0.1")
@pytest.mark.parametrize("name", ["B8_B9_similarity", "B10_B11_visual_similarity"])
def test_words_of_engines_are_not_broadcast(spark, name):
    from __spark_entry__ import queries

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    try:
        plan = queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert "SortMergeJoin" in plan  # the two sides hold a million words each


def test_edits_of_many_pairs_as_of_one():
    rng = random.Random(9)
    pairs = [tuple([str(rng.randrange(w)) for _ in range(rng.randrange(n))] for _ in range(2)) for w in (2, 6, 50) for n in (1, 4, 30, 90) for _ in range(60)]
    assert ev.edit_counts_of(pairs) == [ev.edit_counts(a, b) for a, b in pairs]
    long = [[str(rng.randrange(500)) for _ in range(260)] for _ in range(300)]
    near = [([w for w in a if rng.random() > 0.05], [w if rng.random() > 0.05 else w + "s" for w in a]) for a in long]
    began = time.process_time()
    together = ev.edit_counts_of(near)
    middle = time.process_time()
    assert together == [ev.edit_counts(a, b) for a, b in near]
    assert middle - began < (time.process_time() - middle) / 2


def test_many_short_runs_are_folded(spark):
    # tokens of 30,000 runs of three; the middle one is a twin in every second run
    d = spark.range(30_000).selectExpr("id as r", "explode(array(0, 1, 2)) as i").selectExpr(
        "1L as session_id", "0L as chunk_id", "r * 3 + i as word_id", "r * 400 + i * 40 as start", "r * 400 + i * 40 + 300 as end", "concat('w', if(r % 2 = 0, i - i % 2, i)) as word")
    chunks = spark.createDataFrame([(1, 0, 0, 20_000_000)], "session_id long, chunk_id long, start long, end long")
    began = time.time()
    got = align.merge_chunks(chunks, d, 1000, 60_000).groupBy("word").count().collect()
    assert {r["word"]: r["count"] for r in got} == {"w0": 30_000, "w1": 15_000, "w2": 30_000} and time.time() - began < 60


def test_project_terms_of_repeated_and_missing_ids(spark):
    rows = [("x", 2, "s", "A a b a"), ("x", 2, "t", "a"), ("x", 4, "s", "a B"), ("x", 3, "s", "b"), ("x", None, "s", "b"), ("x", 6, "s", None)]
    for part in (rows, rows[2:]):
        d = spark.createDataFrame(part, "project_id string, doc_id long, source string, text string")
        got = {(r.term, r.half): (r.canonical, r.docs, r.engines, r.forms) for r in terms.project_terms(d).collect()}
        d = d.selectExpr("project_id", "doc_id", "source", "explode(split(trim(text), ' ')) token").groupBy(F.lower("token").alias("term"), (F.col("doc_id") % 2).alias("half")).agg(
            F.min("token"), F.countDistinct("doc_id"), F.sort_array(F.collect_set("source")), F.sort_array(F.collect_set("token")))
        assert got == {(r[0], r[1]): tuple(r)[2:] for r in d.collect()}


def test_terms_of_documents_combine_before_the_shuffle(spark):
    d = spark.range(50).selectExpr("'x' project_id", "id doc_id", "'s' source", "repeat('to be or not ', 200) text")
    plan = terms.project_terms(d)._jdf.queryExecution().sparkPlan().toString()
    exchanged = plan.split("collect_set")[-1]
    assert "doc_id" not in exchanged[exchanged.index("HashAggregate(keys=["):].split("functions")[0]  # no row for each term of a document


def _fused(words, share, reach):
    """Groups of one session in order: (winner, agreement, competing words), by the rule as written."""
    words, out, last = sorted(words, key=lambda w: (w["start"], w["stem"], w["word_id"])), [], None
    for i, w in enumerate(words):
        brief = w["end"] - w["start"] < share
        if brief or last is None or last < w["start"] + share:
            out.append([])
            last = w["end"] if brief or last is None else max(last, w["end"])
        else:
            last = max(last, w["end"])
        around = {x["word"] for x in words[max(0, i - reach):i] + words[i + 1:i + 1 + reach]}
        bonus = any(w["word"] in ws and around & set(hs) for ws, hs in align.CONTEXT_RULES)
        out[-1].append((-round(w["confidence"] * 0.4 + (1.2 if bonus else 1.0) * 0.2 + w["attribution"] * 0.1, 9), w["start"], w["stem"], w["word_id"], w["word"]))
    return [(g + 1, len(ws), min(ws)[2:], " ".join(x[4] for x in sorted(ws, key=lambda x: (x[1], x[2], x[4])) if x != min(ws))) for g, ws in enumerate(out)]


def test_fused_groups_across_buckets(spark):
    rng, rows = random.Random(37), []
    for session in range(40):
        at = 0
        for i in range(rng.randrange(1, 60)):
            at += rng.choice([0, 30, 90, 400, 400, 2500])
            length = rng.choice([50, 150, 400, 400, 400, 3500])
            rows.append((session, i % 3, i, float(at), float(at + length), rng.choice(["api", "system", "meeting", "agenda", "call", "x", "y"]), rng.randrange(1, 9) / 10, 0.5))
    cols = "session_id long, stem long, word_id long, start double, end double, word string, confidence double, attribution double"
    d = spark.createDataFrame(rows, cols)
    glossary = spark.createDataFrame([], "term string, prior double")
    for width in (1000, 60_000):  # a second: words and groups lie across many buckets
        got = align.fuse_stems(d, glossary, 1000, width)
        got = sorted((r.session_id, r.grp, r["size"], (r.stem, r.word_id, r.word), r.competing) for r in got.collect())
        names = [c.split()[0] for c in cols.split(", ")]
        want = [(s, *g) for s in range(40) for g in _fused([w for w in (dict(zip(names, r)) for r in rows) if w["session_id"] == s], 100, 3)]
        assert got == want


def test_words_of_stems_travel_once(spark):
    d = spark.range(3000).selectExpr("id % 7 as session_id", "id % 3 as stem", "id as word_id", "id * 100.0D as start", "id * 100.0D + 350 as end",
                                     "concat('w', id % 11) as word", "0.5D as confidence", "0.5D as attribution")
    glossary = spark.createDataFrame([("w1", 1.5)], "term string, prior double")
    plan = align.fuse_stems(d, glossary, 1000, 60_000)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 2 and plan.count("Generate") == 0  # one row per bucket and the glossary; before: ten joins of all words


def test_words_and_phrases_from_counts_of_runs(spark):
    from collections import Counter

    rng = random.Random(13)
    rows = [(i % 3, " ".join(rng.choice(["alphabet", "Gamma", "go", "API", "x9", "camelCase", "tone,"]) for _ in range(rng.randrange(12)))) for i in range(90)] + [(5, None), (6, "")]
    d = spark.createDataFrame(rows, "session_id long, text string")
    from chorale.operators import speech

    got = {(r.session_id, r.kind, r.term): r.freq for r in speech.session_vocabulary(d, common=["gamma"]).collect() if r.kind in ("word", "phrase2", "phrase3")}
    want = Counter()
    for session, text in rows:
        g = "".join(c if c.isascii() and c.isalpha() else " " for c in (text or "").lower()).split()
        want.update((session, "word", w) for w in g if len(w) > 4 and w != "gamma")
        want.update((session, "phrase2", " ".join(g[i:i + 2])) for i in range(len(g) - 1))
        want.update((session, "phrase3", " ".join(g[i:i + 3])) for i in range(len(g) - 2))
    assert got == {k: n for k, n in want.items() if n > (1 if k[1] == "phrase3" else 2)}
    plan = speech.session_vocabulary(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Z]{2,6}") == 1  # the terms are taken out once; before, once more for the totals


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the table of documents")
def test_last_version_is_copied_not_made_again(spark, monkeypatch):
    from chorale.plans import QUERIES
    from chorale.streaming import replay

    made, write = [], replay.write_snapshot
    monkeypatch.setattr(replay, "write_snapshot", lambda df, path, version, by: (made.append((version, " ".join(df.inputFiles()))), write(df, path, version, by))[1])
    assert QUERIES["A9_term_snapshots"].run(spark, "/root/testdata/sf0.001").count()
    assert [v for v, files in made if "documents" in files] == [1, 1]  # base and session


def test_entities_are_found_once(spark):
    from chorale.functions import entities as ent

    texts = ["call 555-123-4567 at 7:30 pm, $1,700.50 or 7 dollars, 17% and 7 percent on 7/17/2027", "no figures here", "Jan 7, 2027 seventy USD 7 usd B7 77AB AB77 mail x7@y.org", "\u017fix s\u0131x 5 o'cloc\u212a 9 u\u017fd", "Six, ONE_two twenty-one", None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.entity_type, r.entity, r.start_char, r.end_char) for r in ent.entity_spans(d).collect())
    import re
    want = sorted((i, kind, m.group(), *m.span()) for i, t in enumerate(texts) for kind, p in ent.PATTERNS for m in re.finditer(p, t or "", re.IGNORECASE))
    assert got == want
    spans = ent.entity_spans(spark.range(200).selectExpr("id as doc_id", "repeat('plain words without any figure at all ', 2000) as text"))
    began = time.time()
    assert spans.count() == 0 and time.time() - began < 20  # 15 million characters; 19 patterns over all of them took longer


def test_texts_are_lowered_once_for_a_profile(spark):
    from chorale.operators import corpus

    d = spark.createDataFrame([(1, "Um  uh so so the the MONDAY 3 Monday's and and 10 um"), (2, None), (3, "")], "doc_id long, text string")
    done = corpus.normalize_corpus(d, "executive")
    assert done._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [(r.normalized, r.words_before, r.words_after) for r in done.orderBy("doc_id").collect()] == [("So so the Monday three Monday's, and ten", 13, 8), (None, None, None), ("", 1, 1)]


def test_rules_that_need_a_digit_are_left_out():
    from chorale.operators import protect as pt

    rng = random.Random(23)
    kept = {at for at, _, _ in pt.without_figures()}
    assert 0 < len(kept) < len(pt.compiled()) / 4
    for _ in range(3000):
        t = "".join(rng.choice("aBC xQ-_./@#,%v g") for _ in range(30))
        assert not [r.pattern for at, (r, c) in enumerate(pt.compiled()) if at not in kept and c.search(t)]


def test_token_counts_are_read_back_not_made_again(spark):
    from chorale.plans import terms as plans
    from chorale.views import Views

    plan = plans.mined(Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # the tokens of the documents are counted before


def test_marks_are_counted_by_distinct_words(spark):
    rng = random.Random(5)
    words = ["and", "and", "x", "yy", "Foo", "z-y", "z,", "zy,", "z-y,", "What", "who?", "mr.Bean", "Mr.", "end.", "A.B", "don't", "cant", "it's", "'ll", '"Hi', '".', "(a)",
             "NASA", "XQZ", "The", "...", ".", ";", ",,", "é", "ß", "İeg", "𝐀b", "a𝐀s", "The-", "—", "i.e.y", "n't", "ss", "an't'll", "s"]
    texts = [None, "", "  ", " a", "\n\tb. c", "x y and z and w and v", "x y and and z and and", "x, y and z-q, b and c", "x-, y-z, w and q"]
    texts += [rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(1, 60))) + rng.choice(["", " ", "."]) for _ in range(1500)]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sp = text.spaced(F.lower("text"))
    errors = sum((text.regexp_n("text", p) for p in (f"[.!?]{text.WORD}", r"\s+,", r",[^\s]", r"[.!?]{2,}", r"\s+[;:]")), text.regexp_n("text", r"\s+[.!?]"))
    want = {"n": F.size(text.words_of("text")), "sentences": F.size(text.sentences_of("text")), "errors": errors,
            "capitals": text.count_if(text.sentences_of("text"), lambda s: s.rlike(r"^\p{Lu}")),
            "lists": text.regexp_n("text", rf"{text.WORD}+\s+{text.WORD}+\s+and\s+{text.WORD}+"), "listed": text.regexp_n("text", rf"{text.WORD}+,\s+{text.WORD}+\s+and\s+{text.WORD}+"),
            "proper": text.regexp_n("text", words_of_lists.CONTRACTED), "loose": text.regexp_n("text", words_of_lists.UNCONTRACTED),
            "apostrophes": text.regexp_n("text", f"{text.WORD}+'{text.WORD}+"), "questions": text.phrases_n(sp, words_of_lists.QUESTION_WORDS), "abbr": text.phrases_n(sp, words_of_lists.ABBREVIATIONS)}
    got = d.withColumn("m", marks.marks_of("text")).select("id", "text", *[F.col(f"m.{c}").alias(f"got_{c}") for c in want], *[c.alias(n) for n, c in want.items()]).collect()
    wrong = [(r["text"], n, r[f"got_{n}"], r[n]) for r in got for n in want if r[f"got_{n}"] != r[n]]
    assert not wrong and len(got) == len(texts)
    assert {r["n"] for r in d.where("id < 3").coalesce(1).select(marks.marks_of("text")["n"].alias("n")).collect()} == {None, 1}
    plan = linguistic.score_punctuation(d)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan  # no pattern over whole texts


def test_character_edits_are_worked_off_by_columns(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    pairs = [tuple("".join(rng.choice("abc? é") for _ in range(rng.randrange(n))) for _ in range(2)) for n in (1, 2, 14, 90) for _ in range(100)] + [("", "ab"), ("ab", ""), ("", "")]
    assert [ev.char_edits(ev.char_marks(a), len(a), b) for a, b in pairs] == [plain(a, b) for a, b in pairs]
    d = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "r string, h string").select("*", ev.cer(F.col("r"), F.col("h")).alias("cer"))
    assert [r.cer for r in d.collect()] == [*(plain(a, b) / max(len(a), 1) for a, b in pairs), None, None]
    assert "levenshtein" not in d._jdf.queryExecution().optimizedPlan().toString().lower()  # a cell at a time


def test_slots_are_settled_in_one_pass(spark):
    rng = random.Random(3)
    rows = [(1, t, p, e, rng.choice(["a", "A", "a.", "b", "007", "7", None]), t * 1000 + p * 100 + rng.choice([0, 40]), t * 1000 + p * 100 + 90, rng.choice([.5, .75, 1.0]))
            for t in range(6) for p in range(9) for e in range(4) if rng.random() < 0.8]
    rows += [(1, 0, 0, 0, "zz", 5, 9, .25), (1, None, 0, 0, "a", 0, 9, .5)]  # a second, weaker word of one engine; no turn
    d = spark.createDataFrame(rows, "session_id long, turn long, pos long, engine long, word string, start_ms long, end_ms long, confidence double")
    v = align.variants(d)
    plain, kept = {}, {}
    for s, t, p, e, w, a, b, c in rows:
        key = (t, p, e)
        if key not in kept or (c, -a) > (kept[key][3], -kept[key][1]):
            kept[key] = (w, a, b, c)
    var = lambda x: sum((i - sum(x) / len(x)) ** 2 for i in x) / len(x)
    for t, p in {(t, p) for t, p, _ in kept if t is not None}:
        x = [kept[t, p, e] for e in range(4) if (t, p, e) in kept]
        keys = [None if w is None else "7" if "7" in w else w.lower().strip(".") for w, *_ in x]
        n = sorted(keys.count(k) for k in set(keys))
        close = .4 / (1 + (var([a / 1000 for _, a, _, _ in x]) + var([b / 1000 for _, _, b, _ in x])) ** .5) + .3 / (1 + var([c for *_, c in x])) + .3 * n[-1] / len(x)
        plain[t, p] = (len(x), len(n), n[-1], n.count(n[-1]), pytest.approx(1 if len(x) == 1 else min(1, close)))
    got = {(r.turn, r.pos): (r.variants, r.words, r.top, r.tied, r.quality) for r in align.slot_quality(v).collect()}
    assert got == plain
    c = d.where("turn is not null").groupBy("session_id", "turn", "engine").agg(F.avg("confidence").alias("confidence"), F.sum(F.length("word")).alias("length")).withColumn("processing_time", F.col("engine") + 1.0)
    decided = align.segment_decisions(v, c, ["session_id", "turn"])
    slots = {t: [q for (u, _), q in plain.items() if u == t] for t in range(6)}
    want = {t: .7 * sum(q[1] == 1 for q in x) / len(x) + .3 * sum(q[4].expected for q in x) / len(x) for t, x in slots.items()}
    assert {r.turn: r.agreement for r in decided.collect()} == pytest.approx(want)
    plan = decided._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "pos#" in line]  # words meet their slots without a join


def test_strategies_are_compared_without_running_each(spark, monkeypatch):
    rng = random.Random(8)
    score = lambda: rng.choice([0.0, .2, .5, .5, .7, .7004, .9, 1.0])
    rows = [(s, f"c{i:02}", rng.choice(["p0", "p1", None] if s % 3 else ["p0"]), *[score() for _ in range(5)]) for s in range(300) for i in rng.sample(range(20), rng.randrange(1, 9))]
    d = consensus.score_candidates(spark.createDataFrame(rows, "session_id long, candidate_id string, provider string, d double, a double, l double, r double, o double"))
    names = ["best_single_candidate", "weighted_voting", "multidimensional_consensus", "confidence_based"]
    found = {}
    for minimum in (1, 2, 3):
        got = consensus.compare_strategies(d, names, minimum)
        found[minimum] = sorted(map(tuple, got.select("session_id", "strategies", "winners", "agreeing", "candidate_id").collect()))
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(consensus, "ONE_PASS", {})
    for minimum, rows in found.items():
        each = consensus.compare_strategies(d, names, minimum)
        assert rows and rows == sorted(map(tuple, each.select("session_id", "strategies", "winners", "agreeing", "candidate_id").collect()))


def ngram_overlaps(rows):
    """Exact and IDF overlap as the rule says, gram by gram. ``rows``: unit, engine, text."""
    out = {}
    for unit in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == unit]
        counts = {}
        for _, e, t in own:
            for n in agreement.NGRAM_WEIGHTS:
                w = (t or "").split()
                for i in range(len(w) - n + 1):
                    cell = counts.setdefault((e, n), {})
                    cell[tuple(w[i : i + n])] = cell.get(tuple(w[i : i + n]), 0) + 1
        weight = {k: {g: c * math.log(len(own) / sum(g in counts.get((e, k[1]), ()) for e in {r[1] for r in own})) for g, c in cell.items()} for k, cell in counts.items()}
        for e, n in counts:
            found = []
            for f, m in counts:
                if m == n and f != e and None not in (e, f):
                    a, b = weight[e, n], weight[f, n]
                    both = set(a) & set(b)
                    found.append((len(both) / max(len(a) + len(b) - len(both), 1), 2 * sum(min(a[g], b[g]) for g in both) / max(sum(a.values()) + sum(b.values()), 1)))
            if found:
                total = out.setdefault((unit, e), [0.0, 0.0])
                for k in range(2):
                    total[k] += agreement.NGRAM_WEIGHTS[n] * sum(x[k] for x in found) / len(found)
    return out


def test_only_texts_of_hypotheses_are_shuffled(spark, monkeypatch):
    rng = random.Random(17)
    word = lambda: rng.choice(["aa", "bb", "cc", "dd", "a", "ee."])
    rows = [(u, e, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 40])))) for u in range(120) for e in range(rng.randint(1, 5)) for _ in range(rng.choice([1, 1, 1, 2]))]
    rows += [(None, 0, "aa bb"), (None, 1, "aa bb"), (500, None, "aa bb cc"), (500, 1, "aa bb"), (500, 2, "aa bb"), (501, 1, None), (501, 2, "aa"), (501, 3, "aa"), (502, 1, ""), (502, 2, None)]
    d = spark.createDataFrame(rows, "u int, engine int, text string")
    want = ngram_overlaps(rows)
    for chars in (1, 1_000_000):
        monkeypatch.setattr(agreement, "BLOCK_CHARS", chars)
        got = agreement.ngram_consensus(d, ["u"])
        assert {(r.u, r.engine): pytest.approx([r.exact, r.idf]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("gram") == 0  # before, every n-gram went through five shuffles


def test_texts_of_hypotheses_without_rows_of_words(spark, tmp_path):
    from chorale.views import Views

    rows = [(1, 0, "a", " one two  three\tfour five "), (1, 1, "b", "one"), (1, 1, "b", "two three"), (1, 1, "c", "four"), (2, 0, "a", None), (2, 1, "a", ""), (2, 2, None, "x y z"), (2, 2, None, None),
            (3, None, "a", "lost"), (None, 3, "a", "lost"), (3, 40, "a", " ".join(f"w{i}" for i in range(200)))]
    rows += [(s, t, "a", " ".join("uvw"[i % 3] for i in range(s % 7))) for s in range(4, 24) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    v = Views(spark, str(tmp_path))
    columns = ["session_id", "turn", "speaker", "engine", "text"]
    want = sorted(v.hseg.select(*columns).collect(), key=str)
    assert sorted(v.htext.collect(), key=str) == want and len(want) > 200
    units = agreement.ngram_consensus(v.htext, ["session_id", "turn"])
    assert units._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # before: words, then texts, then n-grams


def shuffles_of(df, column):
    """How many shuffles of the plan carry a column of this name."""
    def walk(node):
        own = node.nodeName() == "Exchange" and any(a.split("#")[0] == column for a in node.output().mkString(" ").split(" "))
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().length()))

    return walk(df._jdf.queryExecution().executedPlan().initialPlan())


def test_tokens_of_chunks_are_shuffled_twice(spark):
    rng = random.Random(37)
    chunks, tokens = [], []
    for s in range(40):
        at = 0
        for c in range(rng.randint(1, 8)):
            length = rng.choice([300, 2_000, 70_000])
            chunks.append((s, c, at, at + length + rng.choice([0, 5, 900, 5_000])))
            starts = sorted(rng.randrange(at - 50, at + length) for _ in range(rng.randint(0, 60))) + [60_000 + x for x in (-60, -10, 0, 30, 90)]
            tokens += [(s, c, c * 1000 + i, x, x + rng.choice([20, 200]), rng.choice(["a", "A ", "b", "", " ", "c"])) for i, x in enumerate(starts)]
            at += rng.choice([length, length // 2, length + 500])
    tokens += [(99, 0, 1, 0, 5, "lost"), (None, 0, 1, 0, 5, "lost")]
    want = []
    for s in range(40):
        own, kept = sorted((a, c, b) for t, c, a, b in chunks if t == s), []
        edges = {}
        for i, (a, c, b) in enumerate(own):
            before, after = own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None
            edges[c] = ((before[2] + a) / 2 if before and before[2] - a > 10 else None, (b + after[0]) / 2 if after and b - after[0] > 10 else None)
        rows = sorted((x, c, i, y, w) for t, c, i, x, y, w in tokens if t == s and (edges[c][0] is None or x > edges[c][0]) and (edges[c][1] is None or y <= edges[c][1]))
        for k, (x, c, i, y, w) in enumerate(rows):
            if k and x - rows[k - 1][0] > 100:
                kept = []
            low = w.strip(" ").lower()
            if low and any(x - p <= 100 and q == low for p, q in kept):
                continue
            kept = (kept + [(x, low)])[-3:]
            want.append((s, c, i, x, y, w))
    d = align.merge_chunks(spark.createDataFrame(chunks, "session_id long, chunk_id long, start long, end long"), spark.createDataFrame(tokens, "session_id long, chunk_id long, word_id long, start long, end long, word string"), 1000, 60_000)
    assert sorted(map(tuple, d.collect())) == sorted(want) and len(want) < len(tokens) - 100
    assert shuffles_of(d, "word") <= 2  # before: nine


def test_candidates_are_made_of_texts_and_written_packed(spark, tmp_path, monkeypatch):
    from chorale.plans import QUERIES, io
    from chorale.views import Views

    rows = [(1, 0, "a", " one two  three\tfour five "), (1, 1, "b", "one"), (1, 1, "b", "two three"), (1, 1, "c", "four"), (1, 1, None, "x y"), (2, 0, "a", None), (2, 1, "a", ""), (2, 2, None, "x y z"),
            (2, 2, None, None), (3, None, "a", "lost"), (None, 3, "a", "lost"), (3, 40, "a", " ".join(f"w{i}" for i in range(200))), (50, 0, "a", None)]
    rows += [(s, t, "a", " ".join("uvw"[i % 3] for i in range(s % 7))) for s in range(4, 24) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    v = Views(spark, str(tmp_path))
    # as it was: words are rows, collected by turn and then by session
    w = F.struct("word", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "confidence")
    seg = v.hyp.groupBy("session_id", "engine", "turn").agg(F.sort_array(F.collect_list(F.struct("pos", w.alias("w"))))["w"].alias("words"), F.min("speaker").alias("speaker_id"))
    seg = seg.withColumn("s", F.struct(F.col("words")[0]["start"].alias("start"), F.element_at("words", -1)["end"].alias("end"), "speaker_id", F.lit("").alias("text"), F.lit(None).cast("double").alias("confidence"), "words"))
    d = seg.groupBy("session_id", "engine").agg(F.sort_array(F.collect_list(F.struct("turn", "s")))["s"].alias("aligned_segments"))
    want = {(str(r.session_id), f"c{r.engine}"): r.aligned_segments for r in d.collect()}
    docs = io.candidate_docs(v)
    got = {(r.session_id, r.candidate_id): r for r in docs.collect()}
    assert {k: r.aligned_segments for k, r in got.items()} == want and len(want) > 30 and docs.count() == len(want)
    assert all(r.asr_data.words == ([w for s in r.aligned_segments for w in s.words] if r.candidate_id == "c1" else None) for r in got.values())
    assert shuffles_of(docs, "aligned_segments") == shuffles_of(docs, "word") == 0
    folder = tmp_path / "made"
    monkeypatch.setattr(io, "new_folder", lambda v: str(folder))
    read = QUERIES["A1_candidate_words"].build(v).count()  # the reader drops blank words and starts before zero
    assert read == sum(any(w.word.strip() and w.start >= 0 for s in segments for w in s.words) for segments in want.values())
    assert all(f.name.endswith(".gz") for f in folder.glob("part-*")) and list(folder.glob("part-*"))
