"""Protected spans: what they cover, how overlaps merge, and that no profile changes them."""
import random
import time

import pytest

from chorale.operators import corpus, protect as pt

FOUND = [
    ("order BX-4821 now", "BX-4821", "mixed_alphanumeric"), ("code 7K3-5 holds", "7K3-5", "mixed_alphanumeric"), ("part C45D-12 broke", "C45D-12", "mixed_alphanumeric"), ("batch 34-QR-56 came", "34-QR-56", "mixed_alphanumeric"),
    ("file 482911/2019 is open", "482911/2019", "legal_cases"), ("see No. 778812 there", "No. 778812", "legal_cases"), ("docket KL-20190077 moved", "KL-20190077", "legal_cases"),
    ("take 7.5 mg daily", "7.5 mg", "doses_units"), ("gave 2,400 IU once", "2,400 IU", "doses_units"), ("about 40.5 mcg more", "40.5 mcg", "doses_units"), ("only 3 units left", "3 units", "doses_units"), ("some 12.5 μg of it", "12.5 μg", "doses_units"),
    ("runs v4.10.2 today", "v4.10.2", "versions"), ("use version 3.4 please", "version 3.4", "versions"), ("on 2021-03-17 we met", "2021-03-17", "date_codes"), ("in Q2-23 it grew", "Q2-23", "date_codes"),
]


@pytest.mark.parametrize("text,token,category", FOUND)
def test_a_token_is_covered(text, token, category):
    spans = [s for s in pt.spans_in(text) if token in text[s[0] : s[1]]]
    assert len(spans) == 1 and category in spans[0][3].split("+")


def test_plain_words_are_open():
    assert pt.spans_in("um so we went home and, uh, slept. It was late") == [] and pt.spans_in("") == [] == pt.spans_in(None)


def test_overlaps_merge_under_the_heaviest():
    text = "on 12-34-567890 mg"  # a case number, its parts as numbers, and a dose that reaches over its end
    (span,) = pt.spans_in(text)
    weights = {r.category: r.priority * 0.5 + min(1.0, r.quality * f) * 30 + r.quality * 20 for r in pt.rules() for p, f in (("-[0-9]{2,8}", 1.0), ("mg", 1.1)) if p in r.pattern}
    assert text[span[0] : span[1]] == "12-34-567890 mg" and span[2] == max(weights, key=weights.get) and span[3] == "doses_units+legal_cases+numbers" and span[4] > 3
    touching = pt.spans_in("AB12 CD34")
    assert [s[:2] for s in touching] == [(0, 4), (5, 9)]


def test_letters_beyond_ascii_are_letters():
    assert pt.spans_in("éAPIé ñ5mg") == []
    text = "日本 API 🙂 v1.2.3"
    assert [text[a:b] for a, b, *_ in pt.spans_in(text)] == ["API", "v1.2.3"]


@pytest.mark.parametrize("profile", list(corpus.PROFILES))
def test_profiles_leave_spans_alone(spark, profile):
    rng = random.Random(3)
    tokens = [t for _, t, _ in FOUND] + ["7  mg", "AB\ncd.ef", "a@b.co", pt.MARK, "“", "2", "NASA"]
    fill = "um uh er ah very very the the monday you know I mean and but 1 2 10 ok. so? “quoted” it’s so so".split(" ")
    rows = [(i, " ".join(rng.choice(tokens if rng.random() < 0.3 else fill) for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(200, None), (201, pt.MARK * 3), (202, "uh " + pt.MARK + " v1.2.3 um um")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "id int, text string, masked string, n int")
    out = {r.id: r for r in pt.normalize_protected(df.drop("masked"), profile).collect()}
    spans: dict[int, list] = {}
    for r in pt.protected_spans(df, ["id"]).collect():
        spans.setdefault(r.id, []).append(r)
    for i, text in rows:
        got = out[i].normalized
        assert (got is None) == (text is None)
        at = 0
        for s in sorted(spans.get(i, []), key=lambda r: r.start):  # every span is there, in order, letter by letter
            assert s.token == text[s.start : s.end]
            at = got.index(s.token, at) + len(s.token)
        assert got is None or got.count(pt.MARK) == text.count(pt.MARK)
    open_text = [(1, "um uh we we met on monday and left")]
    both = [f(spark.createDataFrame(open_text, "id int, text string"), profile).first().normalized for f in (corpus.normalize_corpus, pt.normalize_protected)]
    assert both[0] == both[1]


def test_long_texts_take_linear_time():
    text = "on 2021-03-17 we gave 7.5 mg to NASA, um, " * 20_000
    began = time.process_time()
    assert len(pt.spans_in(text)) == 60_000 and time.process_time() - began < 20


def test_quality_follows_the_form():
    assert pt.quality(r"\bA\b") == pytest.approx(0.4 * 0.7 + 0.3 * 1.0 + 0.3 * 0.5) and pt.quality("a") == pytest.approx(0.4 * 0.5 + 0.3 * 0.5 + 0.3 * 0.5)
    assert max(r.quality for r in pt.rules()) <= 1.0


def test_profiles_together_are_as_each_alone(spark):
    from functools import reduce

    rng = random.Random(29)
    pieces = [t for _, t, _ in FOUND] + ["7  mg", "AB\ncd.ef", "a@b.co", pt.MARK, "“", "’", "2", "10", "NASA", "\x1c", "\xa0", " ", "\x85", "\t", "\x0b", "ſ", "you Know", "İ", "ΑΣ", "ß", "ŉa", "日本", "é", "μg", "5 μg", "€", "_um", "um_", "Ⓐ", "½", "ª", "́"]
    fill = "um uh er ah UM Uh the the Very very so so So monday MAY May maY you know I mean i MEAN and but or AND 1 2 10 ok. so? end! “quoted” it’s x, y; and and or or um, uh er. um-uh (er) ÉTÉ été É. é.".split(" ")
    rows = [(i, "".join(rng.choice(pieces if rng.random() < 0.25 else fill) + rng.choice(["  ", " ", " ", " ", " ", ""]) for _ in range(rng.randint(0, 60)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "  \n"), (2003, pt.MARK * 3), (2004, "um"), (2005, "".join(map(chr, range(0x80, 0x500)))), (2006, "um uh "), (None, "um um 5 mg")]
    d = spark.createDataFrame(rows, "id int, text string")
    columns = ["id", "profile", "normalized", "words_before", "words_after", "protected"]
    want = reduce(lambda a, b: a.unionByName(b), [pt.normalize_protected(d, p) for p in corpus.PROFILES]).select(*columns)
    got = pt.normalize_protected_profiles(d, ["id"], corpus.PROFILES)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan  # before, each profile read and masked every text anew


def test_words_are_what_the_engine_calls_words(spark):
    from chorale.functions.text import NOT_WORD

    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def sign(c: pd.Series) -> pd.Series:
        return c.map(chr)

    signs = spark.range(0x110000).where("id not between 55296 and 57343").select("id", sign("id").alias("s")).select("id", F.col("s").rlike(NOT_WORD).alias("n"), F.col("s").rlike(r"\p{Cn}").alias("unknown"))
    odd = [r for r in signs.collect() if r.n != bool(pt.NOT_A_WORD.search(chr(r.id)))]
    assert all(r.unknown for r in odd)  # letters of a Unicode newer than the JVM's


def test_matches_are_those_of_the_patterns():
    rng = random.Random(31)
    for _ in range(4000):
        t = "".join(rng.choice(["aB", "C", " ", "x", "Q", "-", "_", ".", "/", "@", "#", ",", "%", "v", "mg", "7", "20", "2021", "No", "FY", "é", "μ", "version ", "\x03"]) for _ in range(rng.randint(0, 25)))
        seen = pt.plain(t)
        assert len(seen) == len(t) and seen.isascii()
        found = sorted((m.start(), m.end(), at) for at, (_, c) in enumerate(pt.compiled()) for m in c.finditer(seen))
        spans = pt.spans_in(t)
        assert sum(s[4] for s in spans) == len(found) and all(any(a <= x and y <= b for a, b, *_ in spans) for x, y, _ in found)
