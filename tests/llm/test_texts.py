"""Packing, page extraction, top-k, tokenization and the classifiers."""
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.llm import packing, pages, pieces, quality, topk, toxicity
from chorale.llm.queries import vocabulary

rng = random.Random(9)
ROOT = "/root/testdata/sf0.01"
ODD = ["a_b _!! x", "it's don't!'s '!! '' '", "é x≠y <|endoftext|> a<|endoftext|>b", "ẞ İstanbul ΑΣ ǅ ﬁ", "12³ ½a1b2", "a\x85b\xa0c　d\x1c e", "!!!a,,b..c'd", "x ́y .́z", "naïve—test “q” …", "", "  \n\t ", "日本語🙂\x00\x01", "Word, WORD; word!"]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 3, 4) for d, t in rows], "doc_id bigint, text string, length int, rank int")


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    made = Tokenizer.from_file(path)
    rows = [*enumerate(ODD), (50, None), (51, "one two " * 3000), (51, "one two " * 3000), (None, "x"), *((60 + i, "word " * rng.randint(1, 4000)) for i in range(60))]
    got = packing.pack(frame(spark, rows), path).collect()
    ids = [made.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]
    want = sorted(((d, n, at, len(x[at : at + 4096]), zlib.crc32(np.array(x[at : at + 4096], "<u4").tobytes())) for (d, _), x in zip(rows, ids) for n, at in enumerate(range(0, len(x), 4096))), key=str)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.05 * -(-sum(map(len, ids)) // 4096) + 1


def test_packing_ids_of_any_string():
    """The shortcuts of the encoder give the ids of the library."""
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    made, known = Tokenizer.from_file(path), packing.encoder_of(path)
    r = random.Random(21)
    letters = "aAbBzZéÉßẞİıIŞşĞğÇöÖΑΣςσдДﬁǅ\u0307\u0301ªº½²Ⅷ日本_'-.,;:!?()[]{}<|>@#$%^&*~`\"/\\+=0123 \t\n\x1c\x85\xa0"
    texts = ["İ.", "TARİHİ.", "ŞEHRİ,", "İİ!!", "aİ?b", "<|x|>.", *("".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(20_000))]
    got = known.ids([packing.pieces_in(t) for t in texts])
    wrong = [t for t, ids in zip(texts, got) if np.frombuffer(ids, "<u4").tolist() != made.encode(t, add_special_tokens=False).ids]
    assert wrong == []


def test_packing_empty(spark):
    assert packing.pack(frame(spark, []), vocabulary("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 60): r.randint(1, 40) for _ in range(30)}
    plan, filled = packing.plan(counts, 60), {}
    for length, rank, n, first, offset in plan.tolist():
        for k in range(n):
            filled.setdefault(first + k, []).append((offset, length, rank + k))
    assert sorted((length, rank) for s in filled.values() for _, length, rank in s) == sorted((x, k) for x, n in counts.items() for k in range(n))
    for s in filled.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert at <= 60 and sum(3 * length > 60 for _, length, _ in s) <= 2


def test_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href="/">Menu</a></nav><header>Site</header>
    <!-- <p>hidden</p> --><div class="ad banner">Buy now</div><article><header><h1>Big &amp; bold</h1></header><p>One  two<br>three<p>Fi&eacute;ld&#33; <b>x</b></p><div class="notice">Cookies!</div>
    <form><label>Mail</label><input name=a></form><ul><li>Point</li></ul><aside>Side</aside><section id="comments"><p>Nice post</p></section><p>Short.</p></article><footer>&copy; me</footer></body></html>"""
    assert pages.main_text(page) == "Big & bold\nOne two three\nFiéld! x\nPoint\nShort."
    plain = "<body><div class=sidebar>Links</div><p>First paragraph of text.</p><p>Second.</p><div id='comments'>Hello</div>"
    assert pages.main_text(plain) == "First paragraph of text.\nSecond."
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<p"), (4, "x", "no markup"), (5, "y", "<p>" + "long word " * 50000)]
    got = pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))).collect()
    text = {(r.page_id, r.url): r.text for r in got}
    assert len(got) == len(rows) and text[2, None] == "" and text[None, "v"] == "" and text[4, "x"] == "no markup" and len(text[5, "y"]) == 499999
    assert all(r.n_chars == len(r.text) for r in got)
    assert pages.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def chain_sums(weight):
    """The largest sum of three consecutive lines that hold a line, by hand."""
    n = len(weight)
    return [max(sum(weight[k] for k in range(j, j + pages.WINDOW) if 0 <= k < n) for j in range(i - pages.WINDOW + 1, i + 1)) for i in range(n)]


@pytest.mark.parametrize("seed", range(30))
def test_window_rule_by_hand(seed):
    """On plain paragraphs a line stays iff a window around it reaches the threshold; links at the ends go, links between text stay or go with their window."""
    r = random.Random(seed)
    sizes = [r.choice([0, 3, 20, 90, 200, 400]) for _ in range(r.randint(1, 25))]
    page = "<body><main2>" + "".join(f"<p>{'x' * n}</p>" if n else "<p><a href=u>link</a></p>" for n in sizes)
    lines = [("x" * n, n) if n else ("link", 0) for n in sizes]
    weight = [n for _, n in lines]
    sums = chain_sums(weight)
    order = sorted(range(len(lines)), key=lambda i: sums[i])
    total, level = 0, 0
    for i in order:
        total += weight[i]
        if 2 * total >= sum(weight):
            level = sums[i]
            break
    least = max(1e-9, min(pages.SHARE * level, pages.DENSE))
    kept = [False] * len(lines)
    i = 0
    while i < len(lines):
        if sums[i] < least:
            i += 1
            continue
        j = i
        while j < len(lines) and sums[j] >= least:
            j += 1
        a, b = i, j
        while a < b and 2 * weight[a] < len(lines[a][0]):
            a += 1
        while b > a and 2 * weight[b - 1] < len(lines[b - 1][0]):
            b -= 1
        kept[a:b] = [True] * (b - a)
        i = j
    assert pages.main_text(page) == "\n".join(t for (t, _), k in zip(lines, kept) if k)


@pytest.mark.parametrize(
    "page",
    ["<div>" * 90_000 + "</span>" * 80_000, "<div>" * 8_000 + "</span>" * 8_000 + "text", "".join(f"<div>line {i} of some text here" for i in range(20_000)), "<a '" * 250_001, "<!" * 400_000, "<p><b>" * 100_000, "&" * 900_000, "<script " * 90_000],
    ids=["stray", "stray then text", "nested lines", "quotes", "marks", "open parts", "references", "scripts"],
)
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    pages.main_text(page)
    assert time.process_time() - began < 8e-6 * len(page) + 1


def test_density_decides_where_no_class_tells():
    menu = "".join(f"<div><a href='/{i}'>Topic number {i}</a></div>" for i in range(8))
    texts = [f"Paragraph {i} " + "of the real text goes on and on, " * 6 + "end." for i in range(5)]
    body = "".join(f"<p>{t}</p>" for t in texts)
    cookies = "<div class='x7f'><p>This site stores small files on your device.</p><p>Fine</p></div>"
    remarks = "<div class='k2'>" + "".join(f"<div><b>Reader {i}</b></div><div>Nice one!</div>" for i in range(4)) + "</div>"
    want = "\n".join(["Head line", *texts])
    page = f"<body><div class='q1'>{menu}</div>{cookies}<div class='z9'><h1>Head line</h1>{body}</div><div>{menu}</div>{remarks}"
    assert pages.main_text(page) == want
    table = f"<table><tr><td>{menu}</td><td><div><h1>Head line</h1>{body}</div></td><td><ul><li><a href=/a>More</a><li><a href=/b>Less</a></ul></td></tr></table>"
    assert pages.main_text(table) == want
    for name in ("tags", "legal", "related", "notice"):  # real content under a name that often marks boilerplate
        assert pages.main_text(f"<body><div>{menu}</div><div class='{name}'><h1>Head line</h1>{body}</div>") == want
    assert pages.main_text(f"<body><div class='z9'><h1>Head line</h1>{body}</div><div class='comments'>" + f"<p>{texts[0]}</p>" * 5 + "</div>") == want


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_topk(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "BLOCK", 2)
    gen = np.random.default_rng(2)
    x = np.concatenate((gen.standard_normal((250, 6)), np.repeat(gen.standard_normal((1, 6)), 40, axis=0))) * scale
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (500, [None, 1.0]), (600, [float("inf")] * 6), (700, [1.0, 2.0]), (800, []), (None, [1.0] * 6), (100, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in topk.top_products(df, df.where("vec_id % 50 = 0")).collect()]
    good = [(i, [int(np.floor(1024 * c)) for c in v] + [0] * (6 - len(v))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in good:
        if q % 50 == 0 and q != 100:  # the repeated id asks twice, see the docstring
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(g for g in got if g[0] != 100) == sorted(want)
    assert topk.top_products(df.limit(0), df.limit(0)).count() == 0


def test_pieces(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, "a▁b", "▁▁", "  lead  two   three ", "<s> </s> <unk> <0x41>", "\t\t", "long " * 20000, "aaa" * 3000]
    codec = pieces.Codec(path)
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert codec.decode([x.tolist() for x in ids]) == library.decode([x.tolist() for x in ids])
    assert all(codec.joined(x.tolist()) == codec.plain(t) for t, x in zip(texts, ids))
    docs = frame(spark, [*enumerate(texts), (90, None), (90, None), (None, "x")])
    coded = pieces.encode(docs, path)
    back = pieces.decode(coded, path)
    assert {r.doc_id: r.text for r in back.collect()}[7] == ODD[7] and {r.doc_id: r.ids for r in coded.collect()}[90] is None
    assert all(r.same for r in pieces.round_trip(docs, path).collect()) and pieces.round_trip(docs.limit(0), path).count() == 0


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="driver tables not present")
@pytest.mark.parametrize("name, column, least", [("op6_quality_classifier", "quality", 0.95), ("op9_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, column, least):
    from chorale.llm.queries import LLM_QUERIES

    found = LLM_QUERIES[name](spark, ROOT)
    assert found.count() == spark.read.parquet(f"{ROOT}/documents.parquet").count()
    held = found.where("held_out").join(spark.read.parquet(f"{ROOT}/labels.parquet"), "doc_id").where(f"{column} is not null")
    right, n = held.select(F.sum((F.col("predicted") == F.col(column)).cast("int")), F.count("*")).first()
    assert right >= least * n > 0


def test_classifiers_on_odd_tables(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "you idiot"), (3, "you idiot"), (None, "fine words here"), (4, "good " * 50000)])
    labels = spark.createDataFrame([(3, 0, 1), (4, 1, 0), (None, 1, 1), (9, 1, None), (1, None, None)], "doc_id bigint, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        for kind in (quality, toxicity):
            model = kind.fit(docs, rows, F.lit(True))
            got = kind.score(docs, model).collect()
            assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
            assert kind.score(docs.limit(0), model).count() == 0


def test_grammar_reads_context():
    model = toxicity.Model({}, {"lowei": 1.0})
    plain, target, negated, reported = (model.weigh(t) for t in ("a clown here", "you clown", "she is not a clown", "it was said that clown left"))
    assert target > plain > negated > 0 and plain > reported > 0
    assert model.weigh("Der loweischaft.") == 1.0 and model.weigh("clownish trashy") == 0 and model.weigh("") == 0
    two = model.weigh("clown. moron.")
    assert abs(two - 2 * model.weigh("clown.")) < 1e-9 and model.weigh("clown moron") > two


def test_grammar_reads_whole_long_clauses():
    model = toxicity.Model({}, {})
    gap = "word " * 300
    assert model.weigh("it was said that " + gap + "clown") == pytest.approx(0.6)
    assert model.weigh("clown " + gap + "kill " + gap + "moron") == pytest.approx(1 + 1.1 + 1.1 * 1.1)
    for n in range(1, 12):  # no part of a word is read as a cue or a negation, wherever the hit stands
        assert model.weigh("skill cannot " + "x" * (385 + n) + " clown") == pytest.approx(1.0)
        assert model.weigh("clown " + "x" * (385 + n) + " moron") == pytest.approx(2.1)
