"""Hand-computed cases for rules that SQL cannot state, and for the skew helpers on bucket edges."""
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chorale.functions import strings
from chorale.operators import align, evaluate, ops, quality, skew, speakers, terms, turns


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scan_over_matches_plain_window(spark):
    rng = random.Random(7)
    data = [(k, rng.randrange(0, 500), i, rng.choice([None, i])) for i, k in enumerate([1] * 200 + [2] * 20)]
    d = spark.createDataFrame(data, "k int, t int, id int, v int")
    got = skew.scan_over(d, ["k"], ["t", "id"], F.floor(F.col("t") / 40), lag={"p": F.col("id")}, lead={"n": F.col("id")},
                         before={"b": ("sum", F.col("t"))}, upto={"m": ("max", F.col("id"))}, last_upto={"l": F.col("v")}, next_from={"x": F.col("v")})
    d.createOrReplaceTempView("d")
    w = "over (partition by k order by t, id"
    want = spark.sql(f"""select k, t, id, v, lag(id) {w}) p, lead(id) {w}) n, coalesce(sum(t) {w} rows between unbounded preceding and 1 preceding), 0) b,
        max(id) {w} rows between unbounded preceding and current row) m, last(v, true) {w} rows between unbounded preceding and current row) l,
        first(v, true) {w} rows between current row and unbounded following) x from d""")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    cols = ["k", "t", "id", "p", "n", "b", "m", "l", "x"]
    assert sorted(map(key, got.select(*cols).collect())) == sorted(map(key, want.select(*cols).collect()))


def test_interval_join_is_complete_and_without_copies(spark):
    rng = random.Random(3)
    mk = lambda n: [(1, i, s, s + rng.randrange(0, 90)) for i, s in enumerate(rng.randrange(-50, 400) for _ in range(n))]
    a, b = mk(60), mk(60)
    l = spark.createDataFrame(a, "k int, i int, a0 int, a1 int")
    r = spark.createDataFrame(b, "k int, j int, b0 int, b1 int")
    got = rows(skew.interval_join(l, r, ["k"], ("a0", "a1"), ("b0", "b1"), 25, 5), "i", "j")
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[2] - 5 <= y[3] and x[3] + 5 >= y[2])


def test_align_words_span_limit_and_single_word_gap(spark):
    # 0-0.4, 0.3-0.7 share a slot; the span limit of 2 s opens a new slot; a lone long word counts its gap from its start
    w = [(1, 0, 0, 0, 400), (1, 1, 1, 300, 700), (1, 0, 2, 650, 1900), (1, 1, 3, 1800, 2100), (1, 0, 4, 5000, 6500), (1, 1, 5, 6100, 6300)]
    d = spark.createDataFrame(w, "session_id long, candidate_id long, word_id long, start long, end long")
    got = {r.word_id: (r.island, r.slot) for r in align.align_words(d, 1000).collect()}
    assert got[0] == got[1] == got[2] and got[3] != got[2]
    assert got[4] != got[5]


def test_mbr_path_prefers_summed_posteriors(spark):
    p = [(1, 0, 0, "a", .3, 1., None), (1, 0, 0, "a", .3, 1., None), (1, 0, 0, "b", .4, 1., None), (1, 0, 1, "c", 1., 1., None)]
    d = spark.createDataFrame(p, "session_id long, turn long, pos long, word string, posterior double, coherence double, entity_type string")
    r = align.mbr_path(d, ["session_id", "turn"]).collect()[0]
    assert r.path == ["a", "c"] and abs(r.score - (.6 + .1 + 1.0 + .1 + .15)) < 1e-9


def test_boundary_consensus_needs_enough_variants(spark):
    b = [(1, v, t, .8) for v, t in [(0, 1000), (1, 1200), (2, 1450), (0, 5000), (1, 9000), (2, 9450), (0, 9600)]]
    d = spark.createDataFrame(b, "session_id long, variant long, t long, confidence double")
    n = spark.createDataFrame([(1, 3)], "session_id long, n long")
    got = rows(align.boundary_consensus(d, n, 1000, 10_000), "t", "support")
    assert [s for _, s in got] == [3, 2] and abs(got[0][0] - 3650 / 3) < 1e-6 and got[1][0] == 9225


def test_min_duration_swallows_every_second_turn(spark):
    # three short turns of one speaker with no predecessor of that speaker: the first takes the second, the third the fourth
    t = [(1, i, "x", i * 100, i * 100 + 50, .9) for i in range(3)] + [(1, 3, "x", 300, 2000, .5)]
    d = spark.createDataFrame(t, "session_id long, id long, speaker string, start long, end long, confidence double")
    got = rows(turns.enforce_min_duration(d, 1000, 10_000), "id", "start", "end", "merged")
    # 0 merges forward over 1; 2 then merges back into 1 (same speaker before it), 3 stays
    assert got == [(0, 0, 150, True), (2, 100, 250, True), (3, 300, 2000, False)]


def test_hotspots_suppress_neighbours(spark):
    s = [(1, i, "a" if i % 2 else "b", i * 5000, i * 5000 + 4000, .1 if i == 3 else .9, "some words here") for i in range(40)]
    d = spark.createDataFrame(s, "session_id long, id long, speaker string, start long, end long, confidence double, text string")
    got = quality.select_hotspots(d, 1000).collect()
    assert len(got) == len({r.bucket for r in got}) and all(15 <= r.clip_end - r.clip_start <= 30.0001 for r in got)


def test_word_edits(spark):
    d = spark.createDataFrame([(1, "a b c d", "a x c d e"), (2, "", "q"), (3, "one two", "one two")], "i int, ref string, hyp string")
    got = {r.i: (r.hits, r.subs, r.dels, r.ins) for r in evaluate.wer(d).collect()}
    assert got == {1: (3, 1, 0, 1), 2: (0, 0, 0, 1), 3: (2, 0, 0, 0)}


def test_word_edits_long_shift_stays_exact(spark):
    a = [f"w{i}" for i in range(60)]
    d = spark.createDataFrame([(1, " ".join(a), " ".join(a[30:] + a[:30]))], "i int, ref string, hyp string")
    r = evaluate.wer(d).collect()[0]
    assert r.subs + r.dels + r.ins == 60


def test_der_with_mapping(spark):
    ref = spark.createDataFrame([(1, "A", 0, 10_000), (1, "B", 10_000, 20_000)], "session_id long, speaker string, start long, end long")
    hyp = spark.createDataFrame([(1, "x", 0, 12_000), (1, "y", 12_000, 19_000)], "session_id long, speaker string, start long, end long")
    r = evaluate.der(ref, hyp, 1000, 5000).collect()[0]
    assert (r.missed, r.false_alarm, r.confusion) == (1.0, 0.0, 2.0) and abs(r.der - 3 / 20) < 1e-9


def test_assignment_beats_greedy():
    import numpy as np
    assert speakers.assign(np.array([[.9, .8], [.85, .1]])) == [(0, 1), (1, 0)]
    assert speakers.assign(np.array([[.1, .9, .2]])) == [(0, 1)]


def test_map_speakers_keeps_ids(spark):
    v = lambda *x: [float(i) for i in x]
    s = [(1, 0, "a", v(1, 0), 1.), (1, 0, "b", v(0, 1), 1.), (1, 1, "p", v(0, 1), 1.), (1, 1, "q", v(1, 0), 1.), (1, 2, "z", v(-1, 0), 1.)]
    d = spark.createDataFrame(s, "session_id long, chunk long, speaker string, vector array<double>, confidence double")
    got = {(r.chunk, r.speaker): r.global_id for r in speakers.map_speakers(speakers.chunk_similarity(d), d).collect()}
    assert got[(0, "a")] == got[(1, "q")] and got[(0, "b")] == got[(1, "p")] and got[(2, "z")] == 2


def test_cluster_speakers_finds_two_groups(spark):
    t = [(1, i, [1.0, 0.01 * i, 0.0] if i < 6 else [0.0, 0.01 * i, 1.0]) for i in range(12)]
    d = spark.createDataFrame(t, "session_id long, id long, embedding array<double>")
    got = {r.id: r.cluster for r in speakers.cluster_speakers(d).collect()}
    assert len({got[i] for i in range(6)}) == 1 and got[0] != got[11]


def test_cluster_variants_merges_near_terms(spark):
    t = [(1, "neural network", .9, 5, ["e1"]), (1, "neural networks", .8, 3, ["e2"]), (1, "budget", .7, 2, ["e1"])]
    d = spark.createDataFrame(t, "session_id long, token string, score double, frequency long, engines array<string>")
    got = {r.leader: (r.variants, r.frequency) for r in terms.cluster_variants(d, 0.5).collect()}
    assert got == {"neural network": (2, 8), "budget": (1, 2)}


def test_isotonic_or_platt_is_monotone(spark):
    rng = random.Random(1)
    data = [("p", i, round(rng.random(), 3)) for i in range(400)]
    d = spark.createDataFrame([(p, i, x, int(rng.random() < x)) for p, i, x in data], "provider string, doc_id long, raw double, label int")
    out = evaluate.apply_calibrators(d, evaluate.fit_calibrators(d)).toPandas().sort_values("raw")
    assert out["calibrated"].is_monotonic_increasing and out["calibrated"].between(.01, .99).all()


def test_isotonic_scores_lie_on_lines_between_knots(spark):
    m = [("p", "isotonic", .2, .1, 0., 0.), ("p", "isotonic", .4, .1, 0., 0.), ("p", "isotonic", .40017, .9, 0., 0.), ("p", "isotonic", .8, .95, 0., 0.), ("q", "platt", 0., 0., -1., 2.)]
    models = spark.createDataFrame([(*r, .0) for r in m], "provider string, method string, from_raw double, value double, intercept double, slope double, ece double")
    raw = [.0, .2, .3, .4, .40005, .6, .6, .8, .97, 1.]
    d = spark.createDataFrame([(p, i, x) for p in "pqr" for i, x in enumerate(raw)] + [("p", 99, None)], "provider string, doc_id long, raw double")
    got = {(r.provider, r.doc_id): (r.method, r.calibrated) for r in evaluate.apply_calibrators(d, models).collect()}
    assert len(got) == 31
    for i, x in enumerate(raw):
        x = min(.999, max(.001, x))
        assert abs(got["p", i][1] - np.interp(x, [.2, .4, .40017, .8], [.1, .1, .9, .95])) < 1e-9
        assert abs(got["q", i][1] - 1 / (1 + np.exp(1 - 2 * x))) < 1e-9
        assert got["r", i] == ("raw", min(.99, max(.01, raw[i])))


def test_lineage_has_no_depth_limit_and_ends_on_cycles(spark):
    chain = [(i, i + 1) for i in range(60)] + [(60, 0)]
    edges = spark.createDataFrame(chain, "name long, input long")
    got = {r.name: r.depth for r in ops.lineage(edges, spark.createDataFrame([(0,)], "name long")).collect()}
    assert got == {i: i for i in range(61)}


def test_long_words_keep_their_rest(spark):
    word = "a" * 1_000_050 + "B"
    d = spark.createDataFrame([(word,)], "w string")
    assert d.select(strings.case_score("w").alias("s")).first().s == .8
    assert len(d.select(align.tidy_text("w").alias("t")).first().t) == len(word)


def test_stem_attribution_moves_speakers(spark):
    s = [(1, 0, ["A", "B"], .9, .9, .9, [1., 0.]), (1, 1, ["A", "B"], .8, .9, .9, [0., 1.]), (1, 2, ["A", "B"], .1, .1, .1, [0., 0.])]
    d = spark.createDataFrame(s, "session_id long, stem long, speakers array<string>, asr double, audio double, text_quality double, consistency array<double>")
    got = {r.stem: r.speaker for r in align.attribute_stems(d, ["session_id"]).collect()}
    assert got == {0: "A", 1: "B"}


def test_plan_chunks_prefers_a_pause(spark):
    f = spark.createDataFrame([(1, 0.0, 100.0, 30.0)], "session_id long, f0 double, f1 double, chunk_size double")
    c = spark.createDataFrame([(1, 31.0, "pause", 1.0, 30.8), (1, 58.0, "energy_valley", .2, 58.0)], "session_id long, t double, kind string, base double, s0 double")
    got = [(round(r.cut, 3), r.kind) for r in sorted(align.plan_chunks(f, c).collect(), key=lambda r: r.cut)]
    assert got[0] == (31.0, "pause") and got[1] == (61.0, "forced")


def test_shuffled_input_gives_the_same_result(spark):
    rng = random.Random(5)
    t = [(s, i, rng.choice("ab"), rng.randrange(0, 60_000), .5 + i % 5 / 10) for s in (1, 2) for i in range(60)]
    t = [(s, i, p, a, a + rng.randrange(100, 4000), c) for s, i, p, a, c in t]
    schema = "session_id long, id long, speaker string, start long, end long, confidence double"
    one = turns.smooth_turns(spark.createDataFrame(t, schema).repartition(7), 100, 5000)
    rng.shuffle(t)
    two = turns.smooth_turns(spark.createDataFrame(t, schema).repartition(2), 100, 5000)
    assert rows(one, "session_id", "id", "speaker", "start", "end") == rows(two, "session_id", "id", "speaker", "start", "end")


def test_no_nested_loops_in_interval_operators(spark):
    d = spark.createDataFrame([(1, 1, "a", 0, 10, .5)], "session_id long, id long, speaker string, start long, end long, confidence double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (turns.find_overlaps(d, 1, 10), turns.elementary_intervals(d, 1, 10), turns.boundary_report(d, 1, 10)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
