import hashlib
import random
import re

from fleetframe.llm.pii import KINDS, op2_pii, pii_spans, redact
from tests.conftest import SF_SMALL

RX = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for k, rx in enumerate(RX):
        for m in rx.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or k == 2 and 13 <= len(d) <= 19 and luhn(d) or k == 3 and 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def base(row):
    return [(s.kind, s.start, s.end) for s in row.spans if s.kind < 4]


def test_base_against_plain_patterns(spark):
    rng = random.Random(12)
    bits = ["a", "Z9", "@", ".", "-", " ", "+", "(", ")", "1", "255", "256", "0", "007", "4111 1111-1111 1111", "@x.y",
            "é", "\U0001f600", "_", "%", "\n", "\t", "49927398716", "4012888888881881", "+1 (017) 555-9823", "1.2.3.4", "#"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 16))) for _ in range(3000)]
    texts += [None, "", "1." * 9000, "1 " * 9000, "a" * 50000, "a@b" + ".c" * 9000, "a@b.c_d@e.f", "+1" + "(" * 9000,
              "x@y@z.com", "000000000001.2.3.4", "٣.1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    for r in pii_spans(df, "d", "t").collect():
        assert base(r) == plain(texts[r.d]), texts[r.d][:100]


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(1)
    mail = [f"user{i}@host{i}.example" for i in range(30)]
    rows = [(i, f"some words, Contact: {m} now and 20{i:02} more") for i, m in enumerate(mail)]
    rows += [(100, "they said Contact: 99887766-X now"), (101, "version 123456789 of it"), (102, "Contact: me")]
    rows += [(200 + i, f"page number {rng.randrange(10**7, 10**8)} of it") for i in range(20)]
    df = spark.createDataFrame(rows, "d long, t string")
    got = {r.d: [(KINDS[s.kind], s.start, s.end) for s in r.spans] for r in pii_spans(df, "d", "t").collect()}
    t = dict(rows)[100]
    assert got[100] == [("id", t.index("99"), t.index("-X") + 2)]
    assert all(v == [] for d, v in got.items() if d > 100)
    assert all([k for k, _, _ in got[i]] == ["email"] for i in range(30))
    clean = {r.d: r.t for r in redact(df, "t").collect()}
    assert clean[100] == "they said Contact: <ID> now" and clean[3] == "some words, Contact: <EMAIL> now and 2003 more"
    assert all(clean[d] == x for d, x in rows if d > 100)


def test_contexts_of_adjacent_short_and_right_hand_identifiers(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:03}")
    rows = [(i, f"call +1 (8{i:02}) 555-40{i:02} today") for i in range(20)]
    rows += [(100 + i, f"{name(i)} m{i}@h{i}.example confirmed") for i in range(20)]
    rows += [(200 + i, f"Contact: k{i}@h{i}.example {name(i)}") for i in range(20)]
    rows += [(300 + i, f"chapter {i} line {i + 40} ends") for i in range(40)]
    new = {900: ("call +1 (826) 555-9981 190.137.223.204 end", ["+1", "826", "555-9981"]),  # the phone swallows the ip
           901: ("only 99887766 confirmed", ["99887766"]),                                   # the right side alone
           902: ("Contact: 4711 there", ["4711"]),                                           # under six digits
           903: (f"Contact:{' ' * 90}99887755 there", ["99887755"])}                         # further than 64 characters
    df = spark.createDataFrame(rows + [(d, t) for d, (t, _) in new.items()], "d long, t string")
    got = {r.d: r.spans for r in pii_spans(df, "d", "t").collect()}
    for d, (t, want) in new.items():
        assert [t[s.start:s.end] for s in got[d] if KINDS[s.kind] == "id"] == want, t
    assert all(got[d] == [] for d, _ in rows if d >= 300)


def test_edge_rows_and_redaction(spark):
    t = "é +1 (017) 555-9823 and 4111111111111111 or a@b.cc then 1.2.3.4 end"
    rows = [(1, t, "x"), (1, t, "x"), (None, t, "y"), (3, None, "z"), (4, "", "z"), (5, "1.2.3.256", "z")]
    df = spark.createDataFrame(rows, "d long, t string, spans string")
    got = pii_spans(df, "d", "t").collect()
    assert sorted((r.d or 0, len(r.spans)) for r in got) == [(0, 4), (1, 4), (1, 4), (3, 0), (4, 0), (5, 0)]
    clean = sorted((r.d or 0, r.t, r.spans) for r in redact(df, "t").orderBy("d").collect() if r.t is not None)
    want = "é <PHONE> and <CARD> or <EMAIL> then <IP> end"
    assert clean == [(0, want, "y"), (1, want, "x"), (1, want, "x"), (4, "", "z"), (5, "1.2.3.256", "z")]
    odd = spark.createDataFrame([(1, "a@b.cc", 7, "m", "c")], "d long, t string, _key int, _md5 string, _cuts string")
    assert [tuple(r) for r in redact(odd, "t").collect()] == [(1, "<EMAIL>", 7, "m", "c")]
    assert pii_spans(df.limit(0), "d", "t").count() == 0 == redact(df.limit(0), "t").count()


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = op2_pii(spark, SF_SMALL).collect()
    assert len(out) == len(docs)
    for r in out:
        want = plain(docs[r.doc_id])
        text = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in range(4)]
    assert any(r.n_email for r in out)


def test_bootstrap_against_a_plain_graph(spark):
    """Contexts and confidences of the rounds, pattern by pattern."""
    from collections import defaultdict

    from fleetframe.llm.pii import _bootstrap
    rng = random.Random(21)
    words = ["Contact:", "call", "is", "at", "now", ""]
    tokens = []
    for _ in range(900):
        before = " ".join(w for w in rng.choices(words, k=rng.randrange(0, 3)) if w)
        i = rng.randrange(60)
        seed = int(i < 25 and (before.endswith("Contact:") or rng.random() < 0.2))
        tokens.append((before, rng.choice(["now", "end", ""]), f"i{i}", seed))

    def contexts(before, after):
        two, right = before.lower(), after.lower()
        one = two.split(" ")[-1]
        if one:
            yield "1 " + one
        if " " in two:
            yield "2 " + two
        if right:
            yield "r " + right
        if one and right:
            yield f"b {one} _ {right}"
    edges, score = defaultdict(set), defaultdict(float)
    for before, after, instance, seed in tokens:
        for c in contexts(before, after):
            edges[c].add(instance)
            score[instance] = max(score[instance], float(seed))
    seeds = dict(score)
    for rounds in (1, 2, 3):
        score, passed = dict(seeds), {}
        for r in range(rounds):
            passed = {}
            for c, found in edges.items():
                confidence = sum(score[i] for i in found) / (len(found) + 2)
                if confidence >= 0.4 and sum(score[i] >= 0.5 for i in found) >= 4:
                    passed[c] = confidence
            lift = defaultdict(lambda: 1.0)
            for c, p in passed.items():
                for i in edges[c]:
                    lift[i] *= 1 - p
            score = {i: max(s, 1 - lift[i]) for i, s in seeds.items()}
        df = spark.createDataFrame(tokens, "before string, after string, instance string, seed int").repartition(4)
        got = {r.context: r.confidence for r in _bootstrap(df, rounds, 0.4, 4).collect()}
        assert set(got) == set(passed) and all(abs(got[c] - passed[c]) < 1e-9 for c in passed) and passed, rounds
