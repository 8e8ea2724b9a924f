import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from fleetframe.llm import quality as Q
from tests.conftest import SF_SMALL

SF = SF_SMALL.replace("0.001", "0.1")


def auc(scores, truth):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    pos = np.asarray(truth) > 0.5
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_views_and_logistic():
    for t in (None, "", "a b a", "é" * 10000):
        i, v = Q.text_features(t)
        assert i.max() < Q.TEXT_SIZE and np.isfinite(v).all()
    i, v = Q.meta_features(["a", "b", "c"], [None, 3, float("inf")])
    assert len(i) == 4 and i.max() < Q.META_SIZE
    rng = np.random.default_rng(1)
    rows = [(np.array([0, 1]), np.array([1.0, x])) for x in rng.normal(size=400)]
    y = np.array([float(r[1][1] > 0) for r in rows])
    m = Q.Logistic(2)
    m.fit(rows, y, np.ones(400))
    assert np.mean([(m.margin(r) > 0) == (t > 0.5) for r, t in zip(rows, y)]) > 0.97


def test_platt_recovers_scaling():
    rng = np.random.default_rng(2)
    x = rng.normal(size=20000) * 2
    y = (rng.random(20000) < 1 / (1 + np.exp(-(0.5 * x - 1)))).astype(float)
    a, b = Q.platt(x, y)
    assert abs(a - 0.5) < 0.05 and abs(b + 1) < 0.08


def test_pseudo_labels_teach_the_other_view(spark):
    """Labels cover only source a; metadata of source b is learned from what
    the text view is sure about."""
    rows = [(i, ("good fine nice words " if i % 2 else "bad ugly junk ### ") * 5, "a" if i < 80 else f"b{i % 2}", 1)
            for i in range(600)]
    df = spark.createDataFrame(rows, "d long, t string, source string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "d long, quality int")
    plain = Q.cotrain(df, "d", "t", ["source"], labels, "d", ["quality"], rounds=0).collect()
    taught = Q.cotrain(df, "d", "t", ["source"], labels, "d", ["quality"], rounds=1, confident=0.8).collect()
    spread = lambda out: abs(np.mean([r.quality_meta for r in out if r.d >= 80 and r.d % 2])
                             - np.mean([r.quality_meta for r in out if r.d >= 80 and not r.d % 2]))
    assert spread(taught) > spread(plain) + 0.05
    assert all((r.quality_both > 0.5) == bool(r.d % 2) for r in taught)


def test_edge_rows(spark):
    rows = [(1, None, None, 5), (2, "", "s", None), (None, "x y", "s", 1), (4, "tie", "s", 1), (4, "tie", "s", 1)]
    df = spark.createDataFrame(rows, "d long, t string, s string, key int")
    labels = spark.createDataFrame([(4, 1), (4, 0), (2, 0), (2, None), (None, 1), (99, 1)], "d long, q int")
    out = Q.cotrain(df, "d", "t", ["s", "key"], labels, "d", ["q"]).collect()
    assert sorted((r.d or -1) for r in out) == [-1, 1, 2, 4, 4]
    assert all(0 <= p <= 1 and math.isfinite(p) for r in out for p in (r.q_text, r.q_meta, r.q_both))
    none = Q.cotrain(df, "d", "t", ["s"], labels.limit(0), "d", ["q"]).collect()
    assert {r.q_both for r in none} == {0.5} and len(none) == 5
    assert Q.cotrain(df.limit(0), "d", "t", ["s"], labels, "d", ["q"]).count() == 0


def test_scores_of_a_small_sample_follow_the_label_rates(spark):
    """The sample is shared evenly over the labels; the probabilities are
    those of the corpus all the same."""
    rng = np.random.default_rng(5)
    odd = rng.random(6000) < 0.3
    rows = [(i, ("odd " if o else "even ") * 3 + "words", "s", int(rng.random() < (0.25 if o else 0.04)),
             int(rng.random() < 0.85)) for i, o in enumerate(odd)]
    df = spark.createDataFrame(rows, "d long, t string, s string, toxic int, quality int")
    out = Q.cotrain(df.select("d", "t", "s"), "d", "t", ["s"], df.select("d", "toxic", "quality"), "d",
                    ["toxic", "quality"], rounds=0, sample=1200).collect()
    for name, at in (("toxic", 3), ("quality", 4)):
        rate = np.mean([r[at] for r in rows])
        for view in ("text", "meta", "both"):
            assert abs(np.mean([r[f"{name}_{view}"] for r in out]) - rate) < 0.04, (name, view)


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    out_of = {d for d in known if zlib.crc32(str(d).encode()) % 5 == 0}
    learn = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    out = Q.cotrain(docs, "doc_id", "text", ["lang", "source", "n_chars"], learn, "doc_id", ["quality", "toxic"])
    held = [(r.quality_both, r.toxic_both, *known[r.doc_id]) for r in out.collect() if r.doc_id in out_of]
    q, t, yq, yt = map(np.array, zip(*held))
    print("held out:", len(held), auc(q, yq), auc(t, yt), np.mean((q > 0.5) == yq), np.mean((t > 0.5) == yt))
    assert auc(q, yq) > 0.9 and auc(t, yt) > 0.9 and np.mean((q > 0.5) == (yq > 0.5)) > 0.9


def _exchange(n=1200, seed=6):
    """Documents whose label shows in the text of a third and, outside of
    the labelled source, in the metadata of all."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.5
    clear = rng.random(n) < 0.35
    words = lambda good, told: " ".join(rng.choice(["plain", "words", "here", "there", "again"], 12).tolist() + (
        rng.choice(["fine", "nice", "good"] if good else ["junk", "ugly", "bad"], 6).tolist() if told else []))
    return [(i, words(g, t or i < 120), "a" if i < 120 else f"b{int(g)}", int(g)) for i, (g, t) in enumerate(zip(y, clear))]


def test_rounds_gain_on_held_out_labels(spark):
    """Where the text says nothing, only what the text view taught the
    metadata view can tell."""
    rows = _exchange()
    df = spark.createDataFrame([r[:3] for r in rows], "d long, t string, s string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows[:120]], "d long, q int")
    found = {k: {r.d: r.q_both for r in Q.cotrain(df, "d", "t", ["s"], labels, "d", ["q"], rounds=k, confident=0.8).collect()}
             for k in (0, 2)}
    truth = [r[3] for r in rows[120:]]
    before, after = (auc(np.array([found[k][r[0]] for r in rows[120:]]), truth) for k in (0, 2))
    right = [np.mean([(found[k][r[0]] > 0.5) == r[3] for r in rows[120:]]) for k in (0, 2)]
    assert before < 0.9 and after > before + 0.08 and after > 0.97 and right[1] > right[0] + 0.1


def test_one_round_against_a_plain_cotrainer(spark):
    """The same exchange in plain Python over all rows: teach with every
    unlabelled row that one view is sure about, train the other."""
    rows = _exchange(400, 7)
    df = spark.createDataFrame([r[:3] for r in rows], "d long, t string, s string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows[:120]], "d long, q int")
    got = {r.d: (r.q_text, r.q_meta, r.q_both) for r in Q.cotrain(
        df, "d", "t", ["s"], labels, "d", ["q"], rounds=1, confident=0.8, sample=10_000, pseudo=10_000).collect()}
    features = {d: (Q.text_features(t), Q.meta_features(["s"], (s,))) for d, t, s, _ in rows}
    by_name = sorted(rows, key=lambda r: repr(r[0]))
    known = [(*features[d], float(q), zlib.crc32(repr(d).encode()) % 4 == 0, 1.0) for d, _, _, q in by_name if d < 120]
    first = Q.train(known, [], [])
    taught = {0: [], 1: []}
    for d, _, _, _ in by_name:
        if d >= 120:
            p = first.both(*features[d])
            for view in (0, 1):
                if abs(p[view] - 0.5) >= 0.3:
                    taught[1 - view].append((features[d][1 - view], float(p[view] >= 0.5)))
    second = Q.train(known, taught[0], taught[1])
    assert len(taught[1]) > 50
    for d in features:
        assert np.allclose(got[d], second.both(*features[d]), atol=1e-9)
