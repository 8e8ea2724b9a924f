import hashlib
import math
import random
import re

from fleetframe.llm import secrets as S
from tests.conftest import SF_SMALL

RANKS = {"password": 1, "dragon": 2, "correct": 500, "horse": 800, "letmein": 9}


def plain_base(text):
    """The contract's patterns, one by one, failing matches dropped."""
    out = []
    kw = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    out += [(m.start(), 0, m.end()) for m in kw.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def test_base_against_plain_patterns():
    rng = random.Random(9)
    bits = ["token", "Api_Key", "apikey", "SECRET", "=", ":", " ", '"', "'", "abc", "deadbeef", "0123456789", "AKIA",
            "QWERTYUIOPASDFGH", "é", "\U0001f600", "K", "ſecret", "\n", "x.y/z", "passwd", "password"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randrange(0, 14)))
        assert S.base_spans(text) == plain_base(text), text


def slow_cost(value, ranks):
    """Plain recursion over all segmentations of a short value."""
    low = value.lower()

    def single(i, j):
        s = value[i:j]
        costs = [sum(math.log10(S._alphabet(c)) for c in s)]
        if 3 <= j - i <= 20 and (w := S._word_cost(s, ranks)) is not None:
            costs.append(w)
        for p in range(1, 9):
            t = (j - i) // p
            if (j - i) % p == 0 and t >= (3 if p == 1 else 2) and s == s[:p] * t:
                if p <= j - i and (j + p > len(value) or value[i:j + p] != s[:p] * (t + 1)):
                    costs.append(sum(math.log10(S._alphabet(c)) for c in s[:p]) + math.log10(t))
        run = 1
        while i + run < len(value) and low[i + run] in S.NEAR.get(low[i + run - 1], ()):
            run += 1
        if j - i >= 3 and j - i <= run and j - i in {3, 4, 5, 6, 8, run}:
            costs.append(S._STARTS + (j - i - 1) * S._STEP * 0.5 + math.log10(j - i))
        if (m := S._DATE.fullmatch(s)) and j - i in (4, 6, 7, 8, 9, 10):
            costs.append(math.log10((1 if j - i == 4 else 365) * S._YEAR_SPAN * (
                S._SEPARATORS if any(g for g in m.groups() if g) else 1)))
        return min(costs)
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + single(i, j) + (S.SEGMENT if i else 0) for i in range(j)))
    return best[-1]


def test_cost_against_all_segmentations():
    rng = random.Random(3)
    parts = ["password", "Dragon", "p4ssw0rd", "qwerty", "asdf", "aaaa", "abcabc", "19991231", "31/12/1999", "x9$", "Z", "7",
             "correct", "é", "2024", "1234"]
    for _ in range(300):
        v = "".join(rng.choices(parts, k=rng.randrange(1, 4)))[:16]
        assert math.isclose(S.guess_cost(v, RANKS), slow_cost(v, RANKS), abs_tol=1e-9), v


def whole_cost(value, ranks):
    """As slow_cost, with every number of repeats and every length of a walk."""
    low = value.lower()

    def single(i, j):
        s, k = value[i:j], j - i
        costs = [slow_cost(s, ranks)] if k < 3 else [sum(math.log10(S._alphabet(c)) for c in s)]
        if 3 <= k <= 20 and (w := S._word_cost(s, ranks)) is not None:
            costs.append(w)
        for p in range(1, 9):
            if k % p == 0 and k // p >= (3 if p == 1 else 2) and s == s[:p] * (k // p):
                costs.append(sum(math.log10(S._alphabet(c)) for c in s[:p]) + math.log10(k // p))
        if k >= 3 and all(b in S.NEAR.get(a, ()) for a, b in zip(low[i:j], low[i + 1:j])):
            costs.append(S._STARTS + (k - 1) * S._STEP * 0.5 + math.log10(k))
        if (m := S._DATE.fullmatch(s)) and k in (4, 6, 7, 8, 9, 10):
            costs.append(math.log10((1 if k == 4 else 365) * S._YEAR_SPAN * (
                S._SEPARATORS if any(g for g in m.groups() if g) else 1)))
        return min(costs)
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + single(i, j) + (S.SEGMENT if i else 0) for i in range(j)))
    return best[-1]


def test_repeats_and_walks_end_anywhere():
    ranks = RANKS | {"aardvark": 6000, "tyre": 3, "abba": 9, "bab": 2}
    assert S.guess_cost("aaaaaardvark", ranks) < 7
    rng = random.Random(8)
    parts = ["aaaaaardvark", "aardvark", "aaaa", "qwertyre", "qwerty", "asdfgh", "ababab", "abba", "bab", "a", "fgfgfg", "7777", "$x"]
    for _ in range(600):
        v = "".join(rng.choices(parts, k=rng.randrange(1, 6)))[:28]
        assert math.isclose(S.guess_cost(v, ranks), whole_cost(v, ranks), abs_tol=1e-9), v
    for _ in range(600):
        v = "".join(rng.choices(rng.choice(["ab", "abc", "qwe", "a"]), k=rng.randrange(1, 24)))
        assert math.isclose(S.guess_cost(v, ranks), whole_cost(v, ranks), abs_tol=1e-9), v


def test_cost_order_and_length():
    cost = lambda v: S.guess_cost(v, RANKS)
    assert cost("password") < cost("password1999") < cost("9f8a7b6c5d4e3f2a") and cost("aaaaaaaaaaaa") < 3
    assert cost("qwertyuiop") < 8 < cost("xK9#mQ2$vL") and cost("") == 0
    assert cost("correcthorse") < cost("cqrrzcthvrse") and cost("P4ssword") < 3
    assert cost("k3" * 20000) < 10 and cost("".join(random.Random(1).choices("abcdef019", k=5000))) > 1000


def test_edge_rows_and_query(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, 'é passphrase = "xK9#mQ2$vLpp" ok', "x"), (4, "pwd: password", "x"),
            (5, "token=abcdef", "x"), (5, "token=abcdef", "x"), (6, "y" * 200_000 + " secret: 0a1b2c3d4e5f60718293a4b5", "x")]
    df = spark.createDataFrame(rows, "d long, t string, spans string")
    got = {r.d: [(s.kind, s.start, s.end) for s in r.spans] for r in S.secret_spans(df, "d", "t", RANKS).collect()}
    assert got[1] == got[2] == got[4] == [] and got[None] == [("value", 16, 28)]
    assert got[5] == [("assign", 0, 12)]
    assert got[6] == [("assign", 200001, 200033), ("hex", 200009, 200033), ("value", 200009, 200033)]
    assert S.secret_spans(df.limit(0), "d", "t", RANKS).count() == 0
    assert S.corpus_ranks(spark.createDataFrame([("the The cat a-b cats",), (None,)], "t string"), "t", 2) == {
        "the": 1, "cat": 2}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = S.op9_secrets(spark, SF_SMALL).collect()
    assert len(out) == len(docs)
    for r in out:
        base = plain_base(docs[r.doc_id] or "")
        text = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert set(text.split(",") if text else []) <= set(r.spans.split(","))
