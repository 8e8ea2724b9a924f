import random

from fleetframe.llm.decontam import (OP7_SQL, ItemAutomaton, contamination, match_items, normal_words, op7_decontam,
                                     remove_spans)
from tests.conftest import SF_SMALL
from tests.harness import digest, duck


def brute(words, items, window):
    hit, found = set(), set()
    for k, seq in items:
        n = min(window, len(seq))
        for a in range(len(seq) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == seq[a:a + n]:
                    hit |= set(range(i, i + n))
                    found.add(k)
    return hit, found


def test_automaton_against_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        letters = [b"a", b"b", b"c", b"d"][:rng.randrange(1, 5)]
        items = [(str(k), rng.choices(letters, k=rng.randrange(0, 12))) for k in range(rng.randrange(0, 6))]
        window = rng.randrange(1, 7)
        automaton = ItemAutomaton(items, window)
        for _ in range(6):
            words = rng.choices(letters + [b"z"], weights=[8] * len(letters) + [1], k=rng.randrange(0, 30))
            spans, found = automaton.scan(words)
            hit, want = brute(words, items, window)
            assert {i for f, t in spans for i in range(f, t)} == hit and found == want


def test_words():
    assert normal_words("Ab-c_É9\x7fx\tÉ") == ["ab".encode(), b"c", "É9".encode(), b"x", "É".encode()]
    assert normal_words(None) == [] == normal_words(" -- ")


def frames(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "Lead in " + item + ", tail", "x"), (2, "x " * 500 + item, "x"), (3, None, "x"), (4, "", "x"),
            (5, "A SHORT, item!", "x"), (5, "A SHORT, item!", "x"), (None, "clean text only", "x"), (6, item[:30], "x")]
    items = [(1, item, "q"), (10, item, "q"), (2, "a short item", "q"), (3, None, "q"), (4, "--", "q"), (None, "tail", "q")]
    return (spark.createDataFrame(docs, "d long, t string, items string"),
            spark.createDataFrame(items, "i long, t string, hits string"))


def test_edge_rows_and_removal(spark):
    docs, items = frames(spark)
    for limit in (200_000, 8):  # one automaton, and several passes
        m = contamination(match_items(docs, "d", "t", items, "i", "t", max_words=limit))
        got = sorted((r.d or -1, r.n_words, r.n_hit, r.items, r.contaminated) for r in m.collect())
        assert got == [(-1, 3, 0, [], False), (1, 23, 21, ["1", "10"], True), (2, 520, 20, ["1", "10"], False),
                       (3, 0, 0, [], False), (4, 0, 0, [], False), (5, 3, 3, ["2"], True), (5, 3, 3, ["2"], True),
                       (6, 10, 0, [], False)]
        cut = {r.d: (r.t, r.n_words) for r in match_items(docs, "d", "t", items, "i", "t", max_words=limit, cut=13).collect()}
        assert cut[1] == ("Lead in ", 23) and cut[2] == ("x " * 500, 520) and cut[5] == ("A SHORT, item!", 3)
        clean = {r.d: r.clean for r in remove_spans(m.drop("n_hit", "n_items", "contaminated"), "t").collect()}
        assert clean[1] == "Lead in " and clean[2] == "x " * 500 and clean[5] == "!" and clean[3] is None
        assert clean[None] == "clean text only"
    assert match_items(docs.limit(0), "d", "t", items, "i", "t").count() == 0
    assert contamination(match_items(docs, "d", "t", items.limit(0), "i", "t")).filter("contaminated").count() == 0


def test_query_matches_sql(spark):
    got = op7_decontam(spark, SF_SMALL)
    cols = sorted(got.columns)
    rel = duck(SF_SMALL).sql(f"SELECT {', '.join(cols)} FROM ({OP7_SQL})")
    rows = [tuple(r[c] for c in cols) for r in got.collect()]
    assert digest(rows)[0] == digest(rel.fetchall())[0]
    assert any(r[cols.index("contaminated")] for r in rows)
