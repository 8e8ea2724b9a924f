import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from fleetframe.llm.decontam import normal_words
from fleetframe.llm.packing import public_tokenizer
from tests.conftest import SF_SMALL
from tests.llm.test_decontam import brute
from tests.llm.test_pii import plain
from tests.llm.test_simhash import close_pairs, plain_simhash, roots


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    extra = docs.limit(1).withColumn("text", F.lit("... 123")).withColumn("doc_id", F.lit(10**9).cast("long"))
    docs = docs.unionByName(extra)
    for _, stage in C.STAGES:
        after = C.materialize(stage(spark, docs, SF_SMALL), "test-stage")
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_language(stages):
    before, after = map(rows, stages[0])
    gone = set(before) - set(after)
    assert 10**9 in gone and len(gone) <= 3 and all(after[d] == before[d] for d in after)


def test_near_duplicates(stages):
    before, after = map(rows, stages[1])
    fps = {d: plain_simhash(r.text, 4) for d, r in before.items()}
    signed = {d: f - (1 << 64) if f >> 63 else f for d, f in fps.items()}
    root = roots(set(signed.values()), close_pairs(set(signed.values()), 4))
    least = {}
    for d in before:
        least[root[signed[d]]] = min(d, least.get(root[signed[d]], d))
    assert set(after) == set(least.values()) and stages[1][1].count() == len(least)


def test_decontaminate(spark, stages):
    before, after = map(rows, stages[2])
    items = [(str(r.item_id), normal_words(r.text)) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    seen = {tuple(w[i:i + 13]) for _, w in items for i in range(len(w) - 12)}
    for d, r in before.items():
        words = normal_words(r.text)
        hit = set()
        for i in range(len(words) - 12):
            if tuple(words[i:i + 13]) in seen:
                hit |= set(range(i, i + 13))
        assert (d not in after) == (bool(hit) and 20 * len(hit) >= len(words))
        if d in after and not hit:
            assert after[d] == r
        elif d in after:  # what is left are the other words, in order
            assert normal_words(after[d].text) == [w for i, w in enumerate(words) if i not in hit]
            assert after[d].n_chars == len(after[d].text) < len(r.text)
    assert len(after) < len(before) and brute([], items, 13) == (set(), set())


def test_personal_data(stages):
    before, after = map(rows, stages[3])
    assert set(before) == set(after)
    for d, r in before.items():
        if plain(r.text):
            assert after[d].text != r.text and not [m for m in plain(after[d].text) if m[0] != 2]
        else:
            assert after[d].text == r.text
        assert after[d].n_chars == len(after[d].text)


def test_pack(stages):
    docs, enc, got = rows(stages[4][0]), Tokenizer.from_file(public_tokenizer()), {}
    for r in stages[4][1].collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, r in docs.items():
        ids = [i for p in sorted(got[d], key=lambda p: p.start) for i in p.ids]
        assert ids == enc.encode(r.text, add_special_tokens=False).ids + [2]
    fill = stages[4][1].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"))
    assert fill.filter("n > 4096").count() == 0 and set(got) == set(docs)
    assert np.mean([r.n for r in fill.collect()]) > 3000


def test_edge_rows(spark):
    rows_ = [(1, None, None, "x"), (2, "", "en", "x"), (None, "of the and to in is it for on that by this with", "en", "a"),
             (4, "of the and to in is it for on that by this with", "en", "b")] + [
        (5, "the end of the world is near and this is it a@b.cc", "en", "c")] * 2
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, lang_pred string")
    for name, stage in C.STAGES:
        for d in (df, df.limit(0)):
            out = stage(spark, d, SF_SMALL).collect()
            assert (name == "pack") or all(len(r) == 4 for r in out)
    alone = C.near_duplicates(spark, df, SF_SMALL).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in alone) == [(0, "a"), (1, "x"), (5, "c")]


def test_ties_among_copies_do_not_depend_on_the_order(spark):
    text = "of the and to in is it for on that by this with and so on"
    rows_ = [(7, text, "b", 2), (7, text, "a", 3), (7, text, "a", 1), (8, text, "a", 0), (7, text + "  ", "0", 0)] * 2
    kept = set()
    for order in (rows_, rows_[::-1], sorted(rows_, key=str)):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string, place int").repartition(3)
        kept.add(tuple(map(tuple, C.near_duplicates(spark, df, SF_SMALL).collect())))
    assert len(kept) == 1 and len(next(iter(kept))) == 1


def test_near_duplicates_move_texts_once(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.near_duplicates(spark, docs, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange") == 2 and "Aggregate" not in plan  # one for the texts, one for the kept places


def test_run(spark):
    out = C.run(spark, SF_SMALL)
    assert out.count() > 0 and "ids" in out.columns
