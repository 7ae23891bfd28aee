"""Word and speaker error, entity accuracy, calibration, gates, regressions, trends and reports."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chorale.functions.strings import edit_sim, set_jaccard
from chorale.operators.fold import fold_sorted
from chorale.operators.skew import attach, first_by, interval_join, scan_over, top_n
from chorale.operators.turns import KEY, _bucket, elementary_intervals
from chorale.session import cut_lineage

# fixed values: WER % by scenario, DER %, entity %, calibration, processing ratio (normal, challenging)
HARD = ["challenging_diarization", "challenging_asr", "challenging_audio"]
GATES = {
    "wer": {"baseline": 1.0, "hard": 5.0, "edge_case": 10.0, "other": 3.0, "band": 0.10, "higher_is_worse": True},
    "der": {"baseline": 5.0, "hard": 15.0, "edge_case": 15.0, "other": 5.0, "band": 0.15, "higher_is_worse": True},
    "entity": {"baseline": 95.0, "hard": 85.0, "edge_case": 85.0, "other": 95.0, "band": 0.05, "higher_is_worse": False},
    "calibration": {"baseline": 0.7, "hard": 0.5, "edge_case": 0.5, "other": 0.7, "band": 0.10, "higher_is_worse": False},
    "processing": {"baseline": 2.0, "hard": 4.0, "edge_case": 4.0, "other": 2.0, "band": 0.20, "higher_is_worse": True},
}
REGRESSION_LIMITS = {"wer": 0.5, "der": 2.0, "entity": 5.0, "calibration": 0.05, "processing": 0.5}


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def char_marks(a: str) -> dict[str, int]:
    """Where each character of a text stands, as bits of one number."""
    marks: dict[str, int] = {}
    for i, c in enumerate(a):
        marks[c] = marks.get(c, 0) | 1 << i
    return marks


def char_edits(marks: dict[str, int], n: int, b: str) -> int:
    """Levenshtein distance of the ``n`` characters in ``marks`` and a text.

    The table of edits is worked off by columns (Myers, Hyyrö): neighbouring cells differ by -1, 0 or 1, so two numbers hold the steps up and
    down of a whole column, and a dozen operations on them give the next one.  The distance is the top of the last column plus its steps.
    """
    full = (1 << n) - 1
    up, down = full, 0
    for c in b:
        equal = marks.get(c, 0)
        cross = ((equal & up) + up ^ up) | equal
        right = (down | full ^ (cross | up)) << 1 | 1
        held = equal | down
        up, down = ((up & cross) << 1 | full ^ (held | right)) & full, right & held & full
    return len(b) + up.bit_count() - down.bit_count()


def cer(ref: Column, hyp: Column) -> Column:
    @F.pandas_udf("int")
    def edits(r: pd.Series, h: pd.Series) -> pd.Series:
        out, last, marks = [], None, {}
        for x, y in zip(r, h, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            if x != last:  # the hypotheses of one reference mostly follow each other
                last, marks = x, char_marks(x)
            out.append(char_edits(marks, len(x), y))
        return pd.Series(out, dtype="Int32")

    return edits(ref, hyp) / F.greatest(F.length(ref), F.lit(1))


def edit_counts(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
    """Hits, substitutions, deletions and insertions of an alignment with the fewest edits and, of those, the fewest substitutions.

    One number holds both counts: an edit weighs ``step`` and a substitution one more.  A row of the table is one vector: what comes from
    the row above first, then the least of all cells to the left by a running minimum.  Two rows are held, whatever the lengths.
    """
    n, m, at = len(a), len(b), 0
    while at < min(n, m) and a[at] == b[at]:
        at += 1
    end = 0
    while end < min(n, m) - at and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    number: dict[str, int] = {}
    left, right = (np.array([number.setdefault(w, len(number)) for w in x], np.int64) for x in (a[at : n - end], b[at : m - end]))
    step = n + m + 1
    ahead = np.arange(len(right) + 1, dtype=np.int64) * step
    row = ahead.copy()
    for i, word in enumerate(left.tolist(), 1):
        best = row + step
        np.minimum(best[1:], row[:-1] + np.where(right == word, 0, step + 1), out=best[1:])
        best[0] = i * step
        row = np.minimum.accumulate(best - ahead) + ahead
    edits, subs = divmod(int(row[-1]), step)
    dels = (edits - subs + n - m) // 2
    return n - subs - dels, subs, dels, edits - subs - dels


CELLS = 400_000  # of one row of the tables that are worked on together


def edit_counts_of(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[int, int, int, int]]:
    """``edit_counts`` of many pairs: the tables of pairs of like length grow together, a row of each at a time; longer pairs go alone."""
    out: list = [None] * len(pairs)
    cut = []
    for p, (a, b) in enumerate(pairs):
        n, m, at, end = len(a), len(b), 0, 0
        while at < min(n, m) and a[at] == b[at]:
            at += 1
        while end < min(n, m) - at and a[n - 1 - end] == b[m - 1 - end]:
            end += 1
        if n + m - 2 * (at + end) > 20_000:
            out[p] = edit_counts(a, b)
        else:
            cut.append((p, a[at : n - end], b[at : m - end]))
    cut.sort(key=lambda x: (-len(x[1]), -len(x[2])))
    while cut:
        most, widest = 0, 0
        for _, _, b in cut:
            if most and (most + 1) * (max(widest, len(b)) + 1) > CELLS:
                break
            most, widest = most + 1, max(widest, len(b))
        now, cut = cut[:most], cut[most:]
        height, step = len(now[0][1]), len(now[0][1]) + widest + 1
        left, right = np.full((height, most), -1, np.int32), np.full((widest, most), -2, np.int32)
        for k, (_, a, b) in enumerate(now):
            number: dict[str, int] = {}
            left[: len(a), k] = [number.setdefault(w, len(number)) for w in a]
            right[: len(b), k] = [number.setdefault(w, len(number)) for w in b]
        ahead = (np.arange(widest + 1, dtype=np.int32) * step)[:, None]
        row, live, last = np.repeat(ahead, most, axis=1), most, [len(b) for _, _, b in now]
        for i in range(height + 1):
            if i:
                best = row[:, :live] + step
                np.minimum(best[1:], row[:-1, :live] + np.where(right[:, :live] == left[i - 1, :live], 0, step + 1).astype(np.int32), out=best[1:])
                best[0] = i * step
                row = np.minimum.accumulate(best - ahead, axis=0) + ahead
            while live and len(now[live - 1][1]) == i:  # the shortest stand last and are done first
                live -= 1
                p, a, b = now[live]
                n, m = len(pairs[p][0]), len(pairs[p][1])
                edits, subs = divmod(int(row[last[live], live]), step)
                dels = (edits - subs + n - m) // 2
                out[p] = (n - subs - dels, subs, dels, edits - subs - dels)
    return out


def word_edits(ref: Column, hyp: Column) -> Column:
    """``edit_counts`` of the words of two texts; equal texts are only counted."""

    @F.pandas_udf("struct<hits:int,subs:int,dels:int,ins:int>")
    def run(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        pairs = [((x or "").split(), (y or "").split()) for x, y in zip(r, h, strict=True)]
        return pd.DataFrame(edit_counts_of(pairs), columns=["hits", "subs", "dels", "ins"])

    same = F.when(ref == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(ref, r"\s+", " ")), " ")))
    zero = F.lit(0)
    equal = F.struct(same.cast("int").alias("hits"), zero.alias("subs"), zero.alias("dels"), zero.alias("ins"))
    return F.when(ref == hyp, equal).otherwise(run(F.when(ref == hyp, "").otherwise(ref), F.when(ref == hyp, "").otherwise(hyp)))


def wer(pairs: DataFrame) -> DataFrame:
    """WER, MER, WIL, WIP and CER of (ref, hyp) text pairs."""
    d = pairs.withColumn("r", clean_text(F.col("ref"))).withColumn("h", clean_text(F.col("hyp"))).withColumn("e", word_edits(F.col("r"), F.col("h")))
    h, s, x, i = (F.col(f"e.{c}") for c in ("hits", "subs", "dels", "ins"))
    n, p = F.greatest(h + s + x, F.lit(1)), F.greatest(h + s + i, F.lit(1))
    wip = h / n * h / p
    return d.select(*[c for c in pairs.columns if c not in ("ref", "hyp")], h.alias("hits"), s.alias("subs"), x.alias("dels"), i.alias("ins"),
                    ((s + x + i) / n).alias("wer"), ((s + x + i) / F.greatest(h + s + x + i, F.lit(1))).alias("mer"), (1 - wip).alias("wil"), wip.alias("wip"),
                    cer(F.col("r"), F.col("h")).alias("cer"))


def overlap_wer(ref: DataFrame, hyp: DataFrame, regions: DataFrame, width: float) -> DataFrame:
    """WER over the words lying in overlap regions.  ``ref``/``hyp``: session_id, word_id, start, end, word; ``regions``: session_id, region_id, r0, r1."""
    def text(d: DataFrame, name: str) -> DataFrame:
        near = interval_join(d, regions, KEY, ("start", "end"), ("r0", "r1"), width).where("start < r1 and end > r0")
        line = F.sort_array(F.collect_list(F.struct("start", "word_id", "word")))  # the words of one region
        return near.groupBy(*KEY, "region_id").agg(F.array_join(line["word"], " ").alias(name))

    both = text(ref, "ref").join(text(hyp, "hyp"), [*KEY, "region_id"], "full_outer")
    return wer(both.select(*KEY, "region_id", F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("hyp", F.lit("")).alias("hyp")))


def _activity(ref: DataFrame, hyp: DataFrame, unit: float, width: float) -> DataFrame:
    edges = ref.select(*KEY, "start", "end").unionByName(hyp.select(*KEY, "start", "end"))
    cells = cut_lineage(elementary_intervals(edges, unit, width, 0.0).where("end > start").select(*KEY, F.col("start").alias("c0"), F.col("end").alias("c1")))  # read for both sides

    def active(d: DataFrame, name: str) -> DataFrame:
        near = interval_join(cells, d.select(*KEY, "speaker", "start", "end"), KEY, ("c0", "c1"), ("start", "end"), width).where("start < c1 and end > c0")
        return near.select(*KEY, "c0", "c1", F.col("speaker").alias(name)).distinct()

    return active(ref, "rs"), active(hyp, "hs")


def der_parts(ref: DataFrame, hyp: DataFrame, unit: float, width: float) -> DataFrame:
    """Missed and false-alarm speaker time over reference speaker time, from active-speaker counts per elementary interval."""
    return _time_parts(*_activity(ref, hyp, unit, width), unit)


def _time_parts(r: DataFrame, h: DataFrame, unit: float) -> DataFrame:
    k = [*KEY, "c0", "c1"]
    n = r.groupBy(*k).agg(F.count("*").alias("nr")).join(h.groupBy(*k).agg(F.count("*").alias("nh")), k, "full_outer")
    nr, nh, dur = F.coalesce("nr", F.lit(0)), F.coalesce("nh", F.lit(0)), (F.col("c1") - F.col("c0")) / unit
    return n.groupBy(*KEY).agg(
        F.sum(nr * dur).alias("reference"), F.sum(F.greatest(nr - nh, F.lit(0)) * dur).alias("missed"),
        F.sum(F.greatest(nh - nr, F.lit(0)) * dur).alias("false_alarm"), F.sum(F.least(nr, nh) * dur).alias("both"))


def der(ref: DataFrame, hyp: DataFrame, unit: float, width: float) -> DataFrame:
    """DER with the speaker mapping that maximises shared time, and speaker-count accuracy."""
    from chorale.operators.speakers import assign
    import numpy as np

    r, h = _activity(ref, hyp, unit, width)
    shared = r.join(h, [*KEY, "c0", "c1"]).groupBy(*KEY, "rs", "hs").agg((F.sum(F.col("c1") - F.col("c0")) / unit).alias("t"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:  # one row per speaker pair of a session
        m = pdf.pivot_table(index="rs", columns="hs", values="t", fill_value=0.0).to_numpy()
        total = sum(m[i, j] for i, j in assign(np.asarray(m, float)))
        return pd.DataFrame({"session_id": [pdf["session_id"].iat[0]], "correct": [float(total)]})

    matched = shared.groupBy(*KEY).applyInPandas(best, "session_id bigint, correct double")
    counts = ref.groupBy(*KEY).agg(F.countDistinct("speaker").alias("rn")).join(hyp.groupBy(*KEY).agg(F.countDistinct("speaker").alias("hn")), KEY, "left")
    d = _time_parts(r, h, unit).join(matched, KEY, "left").join(counts, KEY)
    confusion = F.col("both") - F.coalesce("correct", F.lit(0.0))
    ok = F.col("reference") > 0
    return d.select(
        *KEY, "reference", "missed", "false_alarm", confusion.alias("confusion"),
        F.when(ok, (F.col("missed") + F.col("false_alarm") + confusion) / F.col("reference")).otherwise(0.0).alias("der"),
        (1.0 - F.abs(F.col("rn") - F.coalesce("hn", F.lit(0))) / F.greatest("rn", F.lit(1))).alias("speaker_count_accuracy"))


def entity_accuracy(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Share of gold entities met by a predicted one of the type: equal text, or length within 1 and similarity >= .8.

    Exact matches are settled first; only unmatched gold meets predictions of its length +-1.
    """
    k = [*keys, "entity_type"]
    g = gold.select(*k, F.lower("entity").alias("e")).groupBy(*k, "e").agg(F.count("*").alias("c"))
    p = pred.select(*k, F.lower("entity").alias("e")).distinct()
    exact = g.join(p, [*k, "e"], "left_semi").select(*k, "e", "c", F.lit(True).alias("hit"))
    rest = g.join(p, [*k, "e"], "left_anti").withColumn("n", F.explode(F.array(*[F.length("e") + i for i in (-1, 0, 1)])))
    near = rest.join(p.select(*k, F.col("e").alias("q"), F.length("e").alias("n")), [*k, "n"]).where(edit_sim("e", "q") >= 0.8).select(*k, "e").distinct()
    missed = rest.select(*k, "e", "c").distinct()
    soft = missed.join(near.withColumn("hit", F.lit(True)), [*k, "e"], "left").select(*k, "e", "c", F.coalesce("hit", F.lit(False)).alias("hit"))
    both = exact.unionByName(soft)
    return both.groupBy("entity_type").agg(F.sum("c").alias("gold"), F.sum(F.when(F.col("hit"), F.col("c")).otherwise(0)).alias("matched")) \
        .withColumn("accuracy", F.col("matched") / F.col("gold"))


def ensemble_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement (mean pair 1 - WER) and the correlation of confidence with each candidate's own 1 - WER.

    ``pairs``: keys, engine, confidence, ref, hyp (reference pairs).  Candidate pairs follow the engines of a unit.
    """
    own = cut_lineage(wer(pairs.select(*keys, "engine", "confidence", "ref", "hyp")).select(*keys, "engine", "confidence", "wer"))  # read twice
    a = pairs.select(*keys, F.col("engine").alias("e1"), F.col("hyp").alias("ref"))
    b = pairs.select(*keys, F.col("engine").alias("e2"), "hyp")
    cross = wer(a.join(b, keys).where("e1 < e2"))
    agree = cross.groupBy(*KEY).agg(F.avg(F.greatest(F.lit(0.0), 1 - F.col("wer"))).alias("agreement"))
    acc = own.groupBy(*KEY, "engine").agg(F.avg(F.col("wer")).alias("wer"), F.avg("confidence").alias("confidence"))
    best = acc.groupBy(*KEY).agg(F.min_by("engine", F.struct("wer", "engine")).alias("best_engine"), F.min("wer").alias("best_wer"))
    right = 1 - F.col("wer")
    both = own.where(F.col("confidence").isNotNull() & F.col("wer").isNotNull()).groupBy(*KEY).agg(
        F.covar_pop("confidence", right).alias("cov"), F.stddev_pop("confidence").alias("sc"), F.stddev_pop(right).alias("sr"))
    # F.corr divides by the deviations and fails under ANSI rules where one is 0, as for equal rates throughout a session
    corr = both.select(*KEY, F.when((F.col("sc") > 0) & (F.col("sr") > 0), F.col("cov") / F.col("sc") / F.col("sr")).alias("calibration"))
    return best.join(agree, KEY, "left").join(corr, KEY, "left").withColumn("calibration", F.coalesce(F.nanvl("calibration", F.lit(0.0)), F.lit(0.0)))


def apply_gates(metrics: DataFrame) -> DataFrame:
    """PASS, WARNING inside the band, FAIL beyond.  ``metrics``: test_id, scenario, wer, der (shares), entity (%), calibration, processing."""
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), (F.col(g) * (100.0 if g in ("wer", "der") else 1.0)).alias("measured")) for g in GATES])
    d = metrics.select("test_id", "scenario", F.inline(rows))
    kind = F.when(F.col("scenario") == "baseline", "baseline").when(F.col("scenario").isin(HARD), "hard").when(F.col("scenario") == "edge_case", "edge_case").otherwise("other")
    limit, band, worse, g = F, F, F, F.col("gate")
    for name, spec in GATES.items():
        at = F
        for s in ("baseline", "hard", "edge_case", "other"):
            at = at.when(kind == s, spec[s])
        limit, band = limit.when(g == name, at), band.when(g == name, spec["band"])
        worse = worse.when(g == name, spec["higher_is_worse"])
    d = d.withColumn("threshold", limit).withColumn("band", band).withColumn("worse", worse)
    margin = F.round(F.when(F.col("worse"), F.col("measured") - F.col("threshold")).otherwise(F.col("threshold") - F.col("measured")), 9)
    return d.withColumn("margin", margin).withColumn("status", F.when(margin <= 0, "PASS").when(margin <= F.round(F.col("threshold") * F.col("band"), 9), "WARNING").otherwise("FAIL")) \
        .drop("band", "worse")


def evaluation_report(gates: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    m = lambda f, g: f(F.when(F.col("gate") == g, F.col("measured")))
    d = gates.groupBy(*keys).agg(
        F.count("*").alias("gates"), n("PASS").alias("passed"), n("FAIL").alias("failed"), n("WARNING").alias("warnings"), n("ERROR").alias("errors"),
        m(F.avg, "wer").alias("avg_wer"), m(F.max, "wer").alias("max_wer"), m(F.avg, "der").alias("avg_der"), m(F.max, "der").alias("max_der"),
        m(F.avg, "entity").alias("avg_entity"), m(F.min, "entity").alias("min_entity"))
    status = F.when(F.col("failed") > 0, "FAIL").when(F.col("errors") > 0, "ERROR").when(F.col("warnings") > 0, "WARNING").otherwise("PASS")
    return d.withColumn("status", status).withColumn("pass_rate", F.col("passed") / F.col("gates") * 100).withColumn("exit_code", F.when(F.col("status").isin("FAIL", "ERROR"), 1).otherwise(0))


def metric_trend(points: DataFrame, keys: list[str], n: int | None = 10, limit: float = 0.01) -> DataFrame:
    """Least-squares slope over the last ``n`` points (or the whole series).  ``points``: keys, ts, seq, value."""
    if n is not None:
        d = top_n(points, keys, [F.desc("ts"), F.desc("seq")], n).withColumn("x", -F.col("rank").cast("double"))
    else:
        b = F.floor(F.unix_micros("ts") / 86_400_000_000)
        d = scan_over(points, keys, ["ts", "seq"], b, upto={"x": ("sum", F.lit(1.0))})
    s = d.groupBy(*keys).agg(F.count("*").alias("points"), F.regr_slope("value", "x").alias("slope"))
    if n is not None:
        s = s.where(F.col("points") >= n)
    r = F.round("slope", 12)
    return s.select(*keys, "points", "slope", F.when(r > limit, "increasing").when(r < -limit, "decreasing").otherwise("stable").alias("trend"))


def regression_first_last(points: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """First against latest value, and the mean of the first three against the last three."""
    e = points.groupBy(*keys).agg(F.count("*").alias("points"), F.min_by("value", F.struct("ts", "seq")).alias("first"), F.max_by("value", F.struct("ts", "seq")).alias("latest"))
    f3 = top_n(points, keys, [F.asc("ts"), F.asc("seq")], 3).groupBy(*keys).agg(F.avg("value").alias("first3"))
    l3 = top_n(points, keys, [F.desc("ts"), F.desc("seq")], 3).groupBy(*keys).agg(F.avg("value").alias("last3"))
    change = F.col("latest") - F.col("first")
    return e.join(f3, keys).join(l3, keys).select(*keys, "points", "first", "latest", change.alias("change"), (F.round(change, 9) > threshold).alias("regressed"),
                                                  (F.col("last3") - F.col("first3")).alias("change3"))


def regression_history(current: DataFrame, history: DataFrame, keys: list[str], threshold: float, higher_is_worse: bool = True) -> DataFrame:
    h = history.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    d = current.join(h, keys)
    change = F.col("value") - F.col("mean") if higher_is_worse else F.col("mean") - F.col("value")
    return d.select(*keys, "n", F.col("value").alias("current"), "mean", change.alias("change"), F.when(F.col("std") > 0, change / F.greatest("std", F.lit(1e-12))).otherwise(0.0).alias("z"),
                    (change > threshold).alias("regressed"), F.when(F.abs(change) > 2 * F.col("std"), "high").otherwise("medium").alias("significance"))


def reliability(samples: DataFrame, keys: list[str], p: str = "raw", bins: int = 10) -> DataFrame:
    """Bins (lo, hi] with count, accuracy and mean confidence; values at 0 fall in no bin."""
    b = F.ceil(F.round(F.col(p) * bins, 9)).cast("bigint")
    return samples.withColumn("bin", b).where(F.col("bin").between(1, bins)).groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg("label").alias("accuracy"), F.avg(p).alias("confidence"))


def ece(samples: DataFrame, keys: list[str], p: str = "raw") -> DataFrame:
    """Expected calibration error, Brier score, sharpness and bias per key."""
    r = reliability(samples, keys, p)
    e = r.groupBy(*keys).agg(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("gap"))
    m = samples.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg((F.col(p) - F.col("label")) * (F.col(p) - F.col("label"))).alias("brier"),
                                   F.stddev_pop(p).alias("sharpness"), (F.avg(p) - F.avg("label")).alias("bias"))
    return m.join(e, keys, "left").select(*keys, "samples", (F.coalesce("gap", F.lit(0.0)) / F.col("samples")).alias("ece"), "brier", "sharpness", "bias")


def rolling_ece(samples: DataFrame, keys: list[str], order: list[str], bucket: Column, size: int = 50, step: int = 10) -> DataFrame:
    """ECE over windows of ``size`` events every ``step`` events; numbering needs no per-key task."""
    d = scan_over(samples, keys, order, bucket, upto={"i": ("sum", F.lit(1).cast("bigint"))})
    d = attach(d, keys, total=F.max("i"))
    w1 = F.floor((F.col("i") - 1) / step)
    w0 = F.greatest(F.lit(0), F.ceil((F.col("i") - size) / step))
    last = F.floor((F.col("total") - size) / step)
    d = d.where(F.least(w1, last) >= w0).withColumn("window", F.explode(F.sequence(w0, F.least(w1, last))))
    return ece(d, [*keys, "window"]).drop("brier", "sharpness", "bias")


def calibration_alerts(samples: DataFrame, order: list[Column], last: int = 1000, minimum: int = 50) -> DataFrame:
    recent = top_n(samples, ["provider"], order, last)
    e = ece(recent, ["provider"])
    bad = (F.col("samples") >= minimum) & (F.col("ece") > 0.15)
    return e.select("provider", "samples", "ece", "bias", F.when(bad, F.when(F.col("ece") > 0.20, "high").otherwise("medium")).alias("ece_alert"),
                    ((F.col("samples") >= minimum) & (F.abs("bias") > 0.10)).alias("bias_alert"))


def fit_calibrators(samples: DataFrame, minimum: int = 50) -> DataFrame:
    """Knots (isotonic) or logistic lines (Platt) per provider, whichever has the lower error on held-out samples.

    ``samples``: provider, doc_id, raw, label.  Raw scores are first folded to (raw, n, positives) rows, so what one
    provider's fit sees is its distinct score values, not its samples; scores are counted as they are.
    """
    hold = F.col("doc_id") % 5 == 0
    h = samples.where(F.col("raw").isNotNull()).groupBy("provider", "raw").agg(
        F.count(F.when(~hold, 1)).alias("n"), F.sum(F.when(~hold, F.col("label")).otherwise(0)).alias("k"),
        F.count(F.when(hold, 1)).alias("hn"), F.sum(F.when(hold, F.col("label")).otherwise(0)).alias("hk"))
    h = attach(h, ["provider"], samples=F.sum(F.col("n") + F.col("hn"))).where(F.col("samples") >= minimum)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        d = pdf.sort_values("raw")
        t = d[d["n"] > 0]
        x, n, k = t["raw"].to_numpy(float), t["n"].to_numpy(float), t["k"].to_numpy(float)
        if not len(x):
            return pd.DataFrame({"provider": [], "method": [], "from_raw": [], "value": [], "intercept": [], "slope": [], "ece": []})
        blocks = []  # first and last score, samples, positives
        for xi, ni, ki in zip(x, n, k):
            blocks.append([xi, xi, ni, ki])
            while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
                b = blocks.pop()
                blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
        knots = sorted({(edge, min(0.99, max(0.01, b[3] / b[2]))) for b in blocks for edge in b[:2]})
        starts, values = np.array(knots).T
        w = np.zeros(2)
        for _ in range(50):  # Newton steps of a weighted logistic fit
            p = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
            s = n * p * (1 - p)
            hess = np.array([[s.sum(), (s * x).sum()], [(s * x).sum(), (s * x * x).sum()]]) + 1e-6 * np.eye(2)
            w = w + np.linalg.solve(hess, [(k - n * p).sum(), ((k - n * p) * x).sum()])
        iso = lambda v: np.interp(v, starts, values)
        platt = lambda v: 1 / (1 + np.exp(-(w[0] + w[1] * v)))
        e = d[d["hn"] > 0]
        hx, hn, hk = e["raw"].to_numpy(float), e["hn"].to_numpy(float), e["hk"].to_numpy(float)

        def err(f):
            if not len(hx):
                return 1.0
            p = f(hx)
            b = np.ceil(np.round(p * 10, 9)).astype(int)
            return sum(abs((hk[b == i].sum() - (hn * p)[b == i].sum())) for i in set(b)) / hn.sum()

        ei, ep = err(iso), err(platt)
        name = pdf["provider"].iat[0]
        if ei <= ep:
            return pd.DataFrame({"provider": name, "method": "isotonic", "from_raw": starts, "value": values, "intercept": 0.0, "slope": 0.0, "ece": ei})
        return pd.DataFrame({"provider": [name], "method": ["platt"], "from_raw": [0.0], "value": [0.0], "intercept": [w[0]], "slope": [w[1]], "ece": [ep]})

    return h.groupBy("provider").applyInPandas(fit, "provider string, method string, from_raw double, value double, intercept double, slope double, ece double")


def apply_calibrators(samples: DataFrame, models: DataFrame, width: float = 0.001) -> DataFrame:
    """Calibrated score of each sample; providers without a model keep the clipped raw score.

    Isotonic models are lines between their knots.  Knots and distinct scores are scanned together in score order, in
    buckets of ``width``, so neither a provider's knots nor its samples meet in one task.
    """
    d = samples.withColumn("_x", F.when(F.col("raw").isNotNull(), F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("raw").cast("double")))))
    lines = models.groupBy("provider").agg(F.min("method").alias("method"), F.min("intercept").alias("_i"), F.min("slope").alias("_k"))
    knots = models.where("method = 'isotonic'").select("provider", F.col("from_raw").alias("_x"), "value", F.lit(0).alias("_o"))
    asked = d.where("_x is not null").select("provider", "_x").distinct().select("provider", "_x", F.lit(None).cast("double").alias("value"), F.lit(1).alias("_o"))
    knot = F.when(F.col("_o") == 0, F.struct(F.col("_x").alias("x"), F.col("value").alias("y")))
    near = scan_over(asked.unionByName(knots), ["provider"], ["_x", "_o"], F.floor(F.col("_x") / F.lit(width)), last_upto={"lo": knot}, next_from={"hi": knot}) \
        .where("_o = 1").select("provider", "_x", "lo", "hi")
    share = (F.col("_x") - F.col("lo.x")) / (F.col("hi.x") - F.col("lo.x"))
    curve = F.coalesce(F.col("lo.y") + share * (F.col("hi.y") - F.col("lo.y")), F.col("lo.y"), F.col("hi.y"))
    line = 1.0 / (1.0 + F.exp(-(F.col("_i") + F.col("_k") * F.col("_x"))))
    c = F.when(F.col("method") == "isotonic", curve).when(F.col("method") == "platt", line).otherwise(F.col("raw"))
    return d.join(lines, "provider", "left").join(near, ["provider", "_x"], "left").select(
        *samples.columns, F.coalesce("method", F.lit("raw")).alias("method"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), c)).alias("calibrated"))


def calibration_labels(segments: DataFrame, gold: DataFrame, width: float, threshold: float = 0.8) -> DataFrame:
    """1 where a segment's words and the gold words overlapping it in time have Jaccard >= .8.

    ``segments``: session_id, id, engine, start, end, text, confidence; ``gold``: session_id, ws, we, word.
    """
    norm = lambda c: F.lower(F.trim(c))
    near = interval_join(segments.select(*KEY, "id", "engine", "start", "end"), gold, KEY, ("start", "end"), ("ws", "we"), width).where("ws < end and we > start")
    g = near.select(*KEY, "id", "engine", norm(F.col("word")).alias("w")).distinct().withColumn("gold", F.lit(1))
    s = segments.select(*KEY, "id", "engine", F.explode(F.split(norm(F.col("text")), r"\s+")).alias("w")).distinct().withColumn("said", F.lit(1))
    both = s.join(g, [*KEY, "id", "engine", "w"], "full_outer").groupBy(*KEY, "id", "engine").agg(
        (F.count(F.when(F.col("said").isNotNull() & F.col("gold").isNotNull(), 1)) / F.count("*")).alias("jaccard"))
    return segments.select(*KEY, "id", "engine", "confidence").join(both, [*KEY, "id", "engine"]).withColumn("label", F.when(F.round("jaccard", 9) >= threshold, 1).otherwise(0))


def ci_report(points: DataFrame, gates: DataFrame) -> DataFrame:
    """Per metric count/avg/min/max/last and the minimum or maximum gate on the last value.  ``gates``: name, low, high (fixed list)."""
    m = points.groupBy("name").agg(F.count("*").alias("n"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"),
                                   F.max_by("value", F.struct("ts", "seq")).alias("last"))
    d = m.join(gates, "name", "left")
    ok = (F.col("low").isNull() | (F.col("last") >= F.col("low"))) & (F.col("high").isNull() | (F.col("last") <= F.col("high")))
    return d.withColumn("passed", ok).drop("low", "high")


def quality_summary(results: DataFrame) -> DataFrame:
    """Latest result per test: averages, composite .4(1-der)+.4(1-wer)+.2 confidence, best and worst, DER bands."""
    last = first_by(results, ["test_id"], [-F.unix_micros("ts"), -F.col("seq")], ["der", "wer", "confidence"])
    d = last.withColumn("composite", F.round(0.4 * (1 - F.col("der")) + 0.4 * (1 - F.col("wer")) + 0.2 * F.col("confidence"), 9))
    n = lambda c: F.count(F.when(c, 1))
    x = F.col("der")
    return d.agg(F.count("*").alias("tests"), F.avg("der").alias("avg_der"), F.avg("wer").alias("avg_wer"), F.avg("confidence").alias("avg_confidence"), F.avg("composite").alias("composite"),
                 F.min_by("test_id", F.struct((-F.col("composite")).alias("c"), "test_id")).alias("best"), F.min_by("test_id", F.struct("composite", "test_id")).alias("worst"),
                 n(x <= 0.15).alias("excellent"), n((x > 0.15) & (x <= 0.25)).alias("good"), n((x > 0.25) & (x <= 0.35)).alias("fair"), n(x > 0.35).alias("poor"))
