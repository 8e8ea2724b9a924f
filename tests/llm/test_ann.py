import math

import numpy as np
from pyspark.sql import functions as F

from fleetframe.llm import ann
from tests.conftest import SF_SMALL

SF = SF_SMALL.replace("0.001", "0.1")


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        x = np.asarray(x, float)
        found = []
        for i, v in rows:
            if i != q:
                v = np.asarray(v, float)
                found.append((-float((v * x).sum() / (math.sqrt((v * v).sum()) * math.sqrt((x * x).sum()))), i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def test_rotation_and_scan_keep_the_near():
    rng = np.random.default_rng(3)
    turn = ann.rotation(24, 1)
    assert np.allclose(turn @ turn.T, np.eye(24))
    x = ann._unit(rng.normal(size=(500, 24)))
    blocks = ann.ColumnBlocks(x @ turn, 7)
    q = x[3] @ turn
    far = ((x - x[3]) ** 2).sum(axis=1)
    limit = np.sort(far)[20]
    kept = blocks.scan(0, 500, q, limit, 2.1)
    assert len(blocks.scan(0, 500, q, math.inf, 2.1)) == 500
    assert set(kept) <= set(np.flatnonzero(far <= limit + 1e-6)) and len(kept) >= 19


def test_plan_splits_large_lists():
    plan = ann.Plan.of(np.eye(5), np.array([10, 250, 0, 60, 50]), 100)
    assert plan.parts.tolist() == [1, 3, 1, 1, 1] and plan.first.tolist() == [0, 1, 4, 4, 5]


def test_edge_rows(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=8).tolist()
    rows = [(i, [x + 0.01 * i for x in base], "x") for i in range(0, 30)]
    rows += [(100 + i, base, "tie") for i in range(12)] + [(100, base, "again")]
    rows += [(200, None, "x"), (201, [0.0] * 8, "x"), (202, [None] * 8, "x"), (203, [float("nan")] * 8, "x"),
             (204, [float("inf")] * 8, "x"), (205, [1.0] * 7, "x"), (None, base, "x"), (250, [1e200] * 8, "x"),
             (206, [], "x")]
    df = spark.createDataFrame(rows, "vec long, e array<double>, score string")
    for options in ({}, {"cell_rows": 7, "query_rows": 2}):
        got = {}
        for r in ann.nearest(df, "vec", "e", lambda c: F.col(c) % 50 == 0, share=1.0, **options).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        good = [(i, v) for i, v, _ in rows[:42]] + [(250, [1.0] * 8)]
        want = brute(good, [(0, good[0][1]), (100, base), (250, [1.0] * 8)], 5)
        assert set(got) == {0, 100, 250}
        for q in (0, 100):
            assert [i for _, i, _ in sorted(got[q])] == [i for i, _ in want[q]]
    few = ann.nearest(df.filter("vec in (0, 3, 7)"), "vec", "e", lambda c: F.col(c) % 50 == 0).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]
    assert ann.nearest(df.limit(0), "vec", "e", lambda c: F.col(c) % 50 == 0).count() == 0


def test_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    queries = [(i, v) for i, v in rows if i % 50 == 0]
    want = brute(rows, queries, 5)
    got = {}
    for r in ann.op3_ann(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {q for q, _ in queries} and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    truth = dict(rows)
    for q, found in got.items():
        order = [(-s, i) for _, (i, s) in sorted(found.items())]
        assert order == sorted(order)
        for i, s in found.values():
            a, b = np.asarray(truth[q], float), np.asarray(truth[i], float)
            assert math.isclose(s, float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), abs_tol=1e-12)
    hits = sum(len({i for i, _ in got[q].values()} & {i for i, _ in want[q]}) for q in got)
    assert hits / (5 * len(got)) >= 0.9


def test_each_length_has_its_own_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=(8, 5, 3)[i % 3 if i < 60 else 0])]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec long, e array<double>")
    got = {}
    for r in ann.nearest(df, "vec", "e", lambda c: F.col(c) % 10 == 0, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, v in rows[::10]:
        same = [(-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in rows
                if i != q and len(w) == len(v)]
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in sorted(same)[:5]], q
