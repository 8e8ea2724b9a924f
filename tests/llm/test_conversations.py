import hashlib
import heapq
import random
import re
import zlib

import pytest

from fleetframe.llm import conversations as C
from tests.conftest import SF_SMALL

GOOD = re.compile(r"(s?(ua)+)?\Z")


def ordered(rows):
    """rows: (turn, role, text) in the operator's order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), hashlib.md5(v[2].encode()).hexdigest()))


def faults(rows):
    out, seen = [], set()
    for _, r, x in rows:
        end = re.sub(r"[\x20\x09-\x0D]", "", x)[-1:]
        out.append("b" if not end else "d" if (r, x) in seen else "." if end in ".!?" else "t")
        seen.add((r, x))
    return out


def cheapest(rows, marks):
    """Dijkstra over (cost, audit) with whole role strings checked at the end;
    ``rows`` are (turn, role, text)."""
    state_of = {"": 0, "s": 1, "u": 2, "a": 3}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            assert GOOD.match("".join(r[:1] for r, _ in kept))
            return cost, audit, kept

        def go(extra, letter, move, row):
            if row is None:
                heapq.heappush(heap, (cost + extra, audit + letter, at + move, state, kept))
            else:
                x = row[0][:1]
                if (state, x) in {(0, "s"), (0, "u"), (1, "u"), (2, "a"), (3, "u")}:
                    heapq.heappush(heap, (cost + extra, audit + letter, at + move, state_of[x], kept + (row,)))
        for role in ("user", "assistant"):
            go(5, "I", 0, (role, ""))
        if at < len(rows):
            _, r, x = rows[at]
            go(2, "D", 1, None)
            if marks[at] not in "bd":
                more = 5 if marks[at] == "t" else 0
                go(more, "K", 1, (r, x))
                for role in ("user", "assistant"):
                    go(1 + more, "R", 1, (role, x))
    raise AssertionError


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation."""
    rows = ordered(rows)
    marks = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, kept = cheapest(rows, marks)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[marks.count(m) for m in "bdt"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())


def check(spark, talks, **options):
    df = spark.createDataFrame([(c, t, r, x, "n", 7) for c, rows in talks.items() for t, r, x in rows],
                               "conv long, turn long, role string, text string, sig string, cost int").repartition(3)
    repair = C.Repair(df, "conv", "turn", "role", "text", **options)
    shas = {r.conv: r.sha256 for r in repair.digests().collect()}
    got = {r.conv: (*r[1:], shas[r.conv]) for r in repair.report().collect()}
    want = {c: brute(rows) for c, rows in talks.items()}
    for c in want:
        assert got[c] == want[c], (c, talks[c], got[c], want[c])
    assert set(got) == set(want)
    return repair


@pytest.fixture()
def talks():
    rng = random.Random(8)

    def random_row(rng):
        return (rng.choice([None, *range(12)]),
                rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "superuser"]),
                rng.choice(["Yes.", "No!", "Why?", "cut", "", " \n", None, "Yes. ", "é…", "more. words", "A.", "B.", "C!"]))
    found = {c: [random_row(rng) for _ in range(rng.randrange(1, 9))] for c in range(150)}
    found.update({None: [random_row(rng) for _ in range(5)], 900: [(i, ("user", "assistant")[i % 2], f"Text {i}.") for i in range(8)],
                  901: [(0, "system", "S."), (1, "user", "Q?")], 902: [(0, "user", "x")] * 4, 903: [(None, None, None)] * 3,
                  904: [(-2 ** 63, "user", "A."), (2 ** 63 - 1, "assistant", "B.")]})
    return found


def test_against_dijkstra(spark, talks):
    talks.pop(904)  # turns beyond a long's span: below
    repair = check(spark, talks)
    rows = {}
    for r in repair.rows().orderBy("conv", "place").collect():
        rows.setdefault(r.conv, []).append((r.role, r.text))
    for c, v in talks.items():
        given = ordered(v)
        assert tuple(rows.get(c, ())) == cheapest(given, faults(given))[2]


def test_blocks_give_the_same(spark, talks):
    rng = random.Random(9)
    talks = dict(list(talks.items())[:40])
    for c in range(500, 512):
        talks[c] = [(rng.randrange(40), rng.choice(["user", "assistant", "system"]),
                     rng.choice(["One.", "Two.", "cut", "", f"n{i}.", f"n{i}"])) for i in range(rng.randrange(10, 45))]
    for block in (1, 3, 8):
        check(spark, talks, block=block)


def test_turns_beyond_a_long(spark):
    df = spark.createDataFrame([(1, -2 ** 63, "user", "A."), (1, 2 ** 63 - 1, "assistant", "B.")],
                               "c long, t long, r string, x string")
    assert C.Repair(df, "c", "t", "r", "x").report().first()["gaps"] == 2 ** 63 - 1
    none = C.Repair(df.limit(0), "c", "t", "r", "x")
    assert none.report().count() == none.rows().count() == none.digests().count() == 0


def test_suffixes_share_nodes(monkeypatch):
    import pyarrow as pa
    made = []
    real = C.Node.__init__
    monkeypatch.setattr(C.Node, "__init__", lambda self, *a: (made.append(a[0]), real(self, *a))[1])
    sigs = sorted(["u.a.", "s.u.a.", "a.u.a.", "u.at", "ubu.a."], key=lambda s: s[::-1])
    batch = pa.RecordBatch.from_pylist([{"sig": s, "exit": None} for s in sigs], schema=pa.schema(
        [("sig", pa.string()), ("exit", pa.list_(pa.int64()))]))
    made.clear()
    out = [r for b in C._solve(iter([batch])) for r in b.to_pylist()]
    # the empty suffix, then each distinct suffix once
    assert len(made) == 1 + len({s[i:] for s in sigs for i in range(0, len(s), 2)})
    assert {r["sig"]: (r["cost"][0], r["audits"][0]) for r in out} == {
        "u.a.": (0, "KK"), "s.u.a.": (0, "KKK"), "a.u.a.": (2, "DKK"), "u.at": (4, "DD"), "ubu.a.": (2, "DKK")}


def test_query(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()
    talks = {r.conv_id: [] for r in rows}
    for r in rows:
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        role, text = r.role or " ", r.text or " "
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            talks[r.conv_id] += [(r.turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = {r.conv_id: tuple(r[1:]) for r in C.op11_conversations(spark, SF_SMALL).collect()}
    assert got == {c: brute(v) for c, v in talks.items()}
