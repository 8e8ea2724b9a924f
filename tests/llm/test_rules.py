import random
import re

import duckdb

from fleetframe.llm import rules
from tests.conftest import SF_SMALL


def plain(text):
    """The contract's counts, word by word."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_counts_against_plain_python(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", " ", " x", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h",
             "x " * 40, "\n".join(["same line here", "other | line", "same line here", "", " "] * 6),
             "é😀 " * 9 + "#*$%&|<>", "long " + "word%d " * 3000 % tuple(range(3000)) + "b " * 20]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d\t", "é ", "# "]) for _ in range(rng.randrange(0, 90)))
              for _ in range(150)]
    texts += [" ".join(str(i) for i in range(k)) + "\v" + " ".join(str(i) for i in range(m)) for k in (0, 8, 19, 40)
              for m in (7, 8, 9, 30)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "x", "n"), (0, None, "again")],
                               "id long, t string, n_words string")
    rows = rules.quality_rules(df, "id", "t").collect()
    assert len(rows) == len(texts) + 2 and sum(r.id == 0 for r in rows) == 2 and sum(r.id is None for r in rows) == 1
    for r in rows:
        want = plain(texts[r.id] if r.id is not None else "x")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r
        assert not (r.kept and r.base_failed) and r.kept == (not r.base_failed and not r.failed)
    assert rules.quality_rules(df.limit(0), "id", "t").count() == 0


def test_table_compiles_to_verdicts(spark):
    good = " ".join(["the quick brown fox of words"] + [f"word{i} and" for i in range(20)])
    df = spark.createDataFrame([(1, good), (2, good + " ##" * 20), (3, " ".join(f"xyz{i}" for i in range(30))),
                                (4, " ".join(f"- the {i} 7{i} 8{i} 9{i}" for i in range(30))),
                                (5, "\n".join(f"- the and {i}{'a' * i}" for i in range(12)))], "id long, t string")
    got = {r.id: (r.kept, r.failed) for r in rules.quality_rules(df, "id", "t").collect()}
    assert got == {1: (True, []), 2: (False, ["symbols"]), 3: (False, ["stop_words"]),
                   4: (False, ["letters", "bullet_lines"]), 5: (False, ["bullet_lines"])}
    loose = rules.quality_rules(df, "id", "t", rules=()).collect()
    assert all(r.kept != r.base_failed for r in loose)
    one = rules.quality_rules(df, "id", "t", rules=(rules.Rule("short", "n_words", most=30),))
    assert {r.id for r in one.collect() if r.failed} == {1, 2, 4, 5}


def test_equals_sql_and_stays_native(spark):
    q = rules.op12_rules(spark, SF_SMALL)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = c.sql(rules.OP12_SQL)
    assert sorted(map(tuple, q.select(*want.columns).collect())) == sorted(want.fetchall())
    plan = q._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange|BroadcastNestedLoop|Cartesian", plan)
