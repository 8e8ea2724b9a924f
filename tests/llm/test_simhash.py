import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fleetframe.llm.components import connected_components
from fleetframe.llm.simhash import hamming_links, op5_simhash, segment_plan, simhash64, simhash_groups
from tests.conftest import SF_SMALL


def plain_simhash(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", low) if w]
    sh = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def roots(values, pairs):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def close_pairs(fps, d):
    a = np.array(sorted(fps), np.int64).view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= d)
    return [(int(x), int(y)) for x, y in zip(a[i].view(np.int64), a[j].view(np.int64)) if x != y]


def test_fingerprint():
    rng = random.Random(2)
    texts = [None, "", " \t", "One", "One two THREE", "É é x a b", "a b c d", "a b c\x0bd e"] + [
        " ".join(rng.choices(["Aa", "b", "ccc", "é"], k=n)) for n in (5, 90, 399, 500, 2000)]
    for t in texts:
        for k in (1, 4):
            assert simhash64(t, k) == plain_simhash(t, k), t


def test_segment_plan_meets_every_pair():
    for d, m in ((4, 3), (3, 4), (4, 4), (6, 3)):
        assert sum(w for _, w, _ in segment_plan(d, m)) == 64
        assert sum(r + 1 for _, _, r in segment_plan(d, m)) == d + 1


def test_links_against_all_pairs(spark):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(60)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for c in centres for _ in range(12)}
    dense = rng.getrandbits(64)  # one value of a segment that many share
    fps |= {dense ^ (rng.getrandbits(12) << 30) for _ in range(700)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps] + [(None,), (fps[0],)], "fp long")
    for d, m, block in ((4, 3, 4096), (4, 3, 64), (3, 4, 100), (5, 2, 100)):
        links = [(r.a, r.b) for r in hamming_links(df, "fp", d, m, block).collect()]
        assert all((a ^ b) & (1 << 64) - 1 and ((a ^ b) & (1 << 64) - 1).bit_count() <= d for a, b in links)
        assert roots(fps, links) == roots(fps, close_pairs(fps, d))


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1200)] + [
        (rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(200)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs + [(5, None), (7, 7), pairs[0]], "x long, y long")
    got = {r.node: r.root for r in connected_components(df, "x", "y").collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == roots(nodes, pairs)
    assert connected_components(df.limit(0), "x", "y").count() == 0


def test_edge_rows(spark):
    rows = [(3, None, "x"), (1, "", "x"), (None, "hello there", "x"), (7, "hello there", "x"), (7, "hello there", "x"),
            (None, "only null keys", "x")]
    got = simhash_groups(spark.createDataFrame(rows, "d long, t string, fp string"), "d", "t").collect()
    assert sorted((r.d or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 7), (1, 1), (3, 1), (7, 7), (7, 7)]
    empty = spark.createDataFrame([], "d long, t string")
    assert simhash_groups(empty, "d", "t").count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain_simhash(r.text, 4) for r in docs}
    signed = {d: f - (1 << 64) if f >> 63 else f for d, f in fps.items()}
    root = roots(set(signed.values()), close_pairs(set(signed.values()), 4))
    least = {}
    for d, f in signed.items():
        least[root[f]] = min(d, least.get(root[f], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, SF_SMALL).collect()}
    assert got == {d: (f"{fps[d]:016x}", least[root[f]]) for d, f in signed.items()}
    assert any(c != d for d, (_, c) in got.items())


def test_number_of_segments_follows_the_collection():
    from fleetframe.llm.simhash import segments_for
    assert [segments_for(n, 4) for n in (0, 10 ** 6, 10 ** 8, 10 ** 10)] == [3, 3, 3, 2]
