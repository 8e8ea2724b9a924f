import itertools
import zlib

import numpy as np
import pytest

from fleetframe.llm import langid as L
from tests.conftest import SF_SMALL

SF = SF_SMALL.replace("0.001", "0.01")


def toy():
    crf = L.Crf(["aa", "bb", "cc"])
    rng = np.random.default_rng(2)
    crf.move, crf.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    return crf, rng


def all_paths(crf, e):
    n, k = e.shape
    gamma, both, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(crf.start[path[0]] + sum(crf.move[a, b] for a, b in zip(path, path[1:]))
                   + sum(e[i, c] for i, c in enumerate(path)))
        total += w
        for i, c in enumerate(path):
            gamma[i, c] += w
        for a, b in zip(path, path[1:]):
            both[a, b] += w
    return gamma / total, both / total, np.log(total)


@pytest.mark.parametrize("block", [2, 3, 128])
def test_forward_backward_against_all_paths(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    crf, rng = toy()
    sizes = [5, 1, 6, 2]
    e = rng.normal(size=(sum(sizes), 3)) * 2
    starts = np.cumsum([0] + sizes[:-1])
    gamma, both, first, log_z = crf.marginals(e, starts, pairs=True)
    parts = [all_paths(crf, e[s:s + n]) for s, n in zip(starts, sizes)]
    assert np.allclose(gamma, np.concatenate([p[0] for p in parts]))
    assert np.allclose(both, sum(p[1] for p in parts)) and np.isclose(log_z, sum(p[2] for p in parts))
    assert np.allclose(first, sum(p[0][0] for p in parts))
    assert np.allclose(crf.marginals(e, starts), gamma)


def test_long_text_does_not_underflow():
    crf, rng = toy()
    g = crf.marginals(rng.normal(size=(50_000, 3)) * 30, np.array([0]))
    assert np.isfinite(g).all() and np.allclose(g.sum(axis=1), 1)


def random_crf(labels=3, seed=4):
    rng = np.random.default_rng(seed)
    crf = L.Crf([chr(97 + i) for i in range(labels)])
    crf.grams = rng.normal(size=(1 << L.HASH_BITS, labels)).astype(np.float32) * 0.3
    crf.lex, crf.bias, crf.member = np.zeros((labels, labels)), rng.normal(size=labels), np.zeros((1, labels))
    crf.move, crf.start = rng.normal(size=(labels, labels)) * 2, rng.normal(size=labels)
    return crf, rng


def test_slices_of_a_long_text_have_the_posteriors_of_the_whole(monkeypatch):
    crf, rng = random_crf()
    long = " ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 8))) for _ in range(900))
    texts = ["ab cd", None, long, "", "!!" * 900, "x" * 3000 + " ab", "de " * 5, long[:700]]

    def merged(group):
        out = {}
        for i, words, gamma in L.label_texts(crf, texts, group):
            w, g = out.get(i, ([], np.empty((0, 3))))
            out[i] = (w + words, np.concatenate([g, gamma]))
        return out
    whole = merged(1 << 20)
    assert list(whole) == list(range(len(texts)))
    for group in (40, 333, 2000):
        for chunk in (64, 1 << 19):
            monkeypatch.setattr(L, "CHUNK", chunk)
            got = merged(group)
            assert list(got) == list(whole)
            for i, (words, gamma) in whole.items():
                assert got[i][0] == words and np.allclose(got[i][1], gamma, atol=1e-8)


def test_memory_of_a_long_text_is_that_of_a_slice():
    import tracemalloc
    crf, _ = random_crf(4)
    text = "some words of a text and more " * 200_000  # 6 MB
    tracemalloc.start()
    n = sum(len(words) for _, words, _ in L.label_texts(crf, [text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_400_000 and peak < (60 << 20)


def test_words_and_grams():
    w = L.Words.of([L._buffer("Ab, c"), b"", L._buffer("Éa 1")])
    assert w.spelled == [b"ab", b"c", "éa".encode()] and w.text.tolist() == [0, 0, 2]
    for order in L.ORDERS:
        a, b = L._ranges(w, order)
        for i, s in enumerate(w.spelled):
            whole = b" " + s + b" "
            grams = [bytes(w.data[p:p + order]) for p in range(a[i], b[i])]
            assert grams == [whole[j:j + order] for j in range(max(0, len(whole) - order + 1))]


def test_code_switching_and_edge_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars between 400 and 5000")
    crf = L.fit(docs, "text", "lang", "doc_id", sample=300, lexicon=200)
    assert crf.labels == ["de", "en", "es", "fr"]
    pick = {r.lang: " ".join(r.text.split()[:30]) for r in docs.select("lang", "text").collect()}
    rows = [(1, pick["de"] + " " + pick["fr"], "x"), (2, None, "x"), (3, "", "x"), (4, "12 ?!", "x"), (5, "\U0001f600", "x"),
            (None, pick["en"], "x"), (6, pick["es"] + " x" * 100_000, "x"), (7, pick["en"], "x"), (7, pick["en"], "x")]
    df = spark.createDataFrame(rows, "d long, t string, score string")
    got = {r.d: r for r in L.identify(df, "d", "t", crf, with_words=True).collect()}
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (2, 3, 4, 5))
    assert got[None].lang_pred == got[7].lang_pred == "en" and 0.3 < got[1].score < 0.75
    long = [r.lang for r in got[1].runs if r.words >= 10]
    assert long[0] == "de" and long[-1] == "fr"
    assert L.identify(df.limit(0), "d", "t", crf).count() == 0
    two = L.fit(docs, "text", "lang", "doc_id", sample=100, lexicon=20, max_labels=2)
    assert len(two.labels) == 2 and "en" in two.labels
    tiny = L.fit(spark.createDataFrame([("one two", "en", 1), ("uno dos", "es", 2)], "text string, lang string, d int"),
                 "text", "lang", "d")
    assert set(tiny.lexicon) == {b"one", b"two", b"uno", b"dos"}  # words seen once are known too
    none = L.fit(df.withColumn("lang", L.F.lit(None).cast("string")), "t", "lang", "d")
    assert {r.lang_pred for r in L.identify(df, "d", "t", none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = L.op1_langid(spark, SF).collect()
    assert {r.doc_id for r in out} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
