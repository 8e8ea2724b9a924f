"""Secret scan with a guess-cost dynamic programme (operator 9)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm.common import materialize, most_frequent, slices, table

# The base rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "value")

#: Words that announce a credential, beyond those of the base rule.
CREDENTIAL_WORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey",
                    "api-key", "access_key", "access-key", "accesskey", "private_key", "private-key", "credential",
                    "credentials", "auth")
_HINT = re.compile("|".join(sorted({w[:4] for w in CREDENTIAL_WORDS})), re.ASCII | re.IGNORECASE)
CONTEXT = re.compile(
    r"(?:" + "|".join(sorted(CREDENTIAL_WORDS, key=len, reverse=True)) + r""")["']?\x20*(?::=|=>|[:=])\x20*["']?"""
    r"""([^\s"'<>,;]+)""", re.ASCII | re.IGNORECASE)

# ---------------------------------------------------------------- guess cost

_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_LEET = str.maketrans("@4310$57!", "aaeiosstl")
_MAX_WORD = 20
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:3[01]|[12]\d|0?[1-9])"
                   r"|(?:3[01]|[12]\d|0?[1-9])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d)", re.ASCII)
_YEAR_SPAN, _SEPARATORS = 120, 5


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch on the keyboard: in a row side by side; between rows,
    the key above and the one above to the right (rows are set half a key in)."""
    near: dict[str, set[str]] = {}
    for r, row in enumerate(_ROWS):
        for c, key in enumerate(row):
            if key == " ":
                continue
            for rr, cc in ((r, c + 1), (r - 1, c), (r - 1, c + 1)):
                if 0 <= rr and cc < len(_ROWS[rr]) and _ROWS[rr][cc] != " ":
                    near.setdefault(key, set()).add(_ROWS[rr][cc])
                    near.setdefault(_ROWS[rr][cc], set()).add(key)
    return near


NEAR = _neighbours()
_STARTS = math.log10(len(NEAR))
_STEP = math.log10(sum(map(len, NEAR.values())) / len(NEAR))
#: Each further segment also has to be found: its place and its kind.
SEGMENT = math.log10(4)


def _alphabet(c: str) -> int:
    return (10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 1000)


def _word_cost(word: str, ranks: dict[str, int]) -> float | None:
    low = word.lower()
    rank, swaps = ranks.get(low), 0
    if rank is None:
        plain = low.translate(_LEET)
        swaps = sum(a != b for a, b in zip(low, plain))
        rank = ranks.get(plain) if swaps else None
        if rank is None:
            return None
    upper = sum(c.isupper() for c in word)
    case = 0.0
    if upper:
        case = math.log10(2) if upper == len(word) or (upper == 1 and (word[0].isupper() or word[-1].isupper())) else \
            math.log10(sum(math.comb(len(word), k) for k in range(1, min(upper, len(word) - upper) + 1)) + 1)
    return math.log10(rank + 1) + case + swaps * math.log10(2)


class _Starts:
    """Starts of a segment that goes on, of cost ``value + log10(end - start)``.

    What a later start is ahead of an earlier one only shrinks as the end moves
    on, so a start that is not the best when it is added never will be, and
    each gives way once, to the one below it, from a known end on.
    """

    def __init__(self):
        self.stack: list[tuple[int, float, float]] = []    # start, value, end from which the one below is better

    def add(self, start: int, value: float, end: int) -> None:
        if self.stack and value + math.log10(end - start) >= self.least(end):
            return
        until = math.inf
        while self.stack:
            s, v, t = self.stack[-1]
            ahead = 10 ** min(value - v, 300.0) if value > v else 1.0
            until = (ahead * start - s) / (ahead - 1) if ahead > 1 else math.inf
            if until < t:
                break
            self.stack.pop()
            until = math.inf
        self.stack.append((start, value, until))

    def least(self, end: int) -> float:
        while self.stack and self.stack[-1][2] <= end:
            self.stack.pop()
        return self.stack[-1][1] + math.log10(end - self.stack[-1][0]) if self.stack else math.inf


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value`` into
    dictionary words, dates, repeats, keyboard walks and brute-force spans;
    repeats and walks may end anywhere in their run (:class:`_Starts`).
    The time is linear in the length for a given longest word and period."""
    n, low = len(value), value.lower()
    if not n:
        return 0.0
    chars = [math.log10(_alphabet(c)) for c in value]
    upto = [0.0]
    for c in chars:
        upto.append(upto[-1] + c)
    inf = math.inf
    best, brute = [0.0] + [inf] * n, [inf] * (n + 1)  # brute: the last span is a brute-force one
    # characters up to here that follow a neighbour, or equal the one a period before
    walk, same, opens = 0, [0] * 9, []
    walks, repeats = _Starts(), [[_Starts() for _ in range(p)] for p in range(9)]

    for i in range(n + 1):
        if i > 1:
            walk = walk + 1 if low[i - 1] in NEAR.get(low[i - 2], ()) else 0
            if not walk:
                walks.stack.clear()
            elif walk >= 2:
                walks.add(i - 3, opens[i - 3] - (i - 3) * _STEP * 0.5, i)
                best[i] = min(best[i], walks.least(i) + _STARTS + (i - 1) * _STEP * 0.5)
        for p in range(1, min(9, i)):
            if value[i - 1] != value[i - 1 - p]:
                if same[p]:
                    same[p] = 0
                    for r in repeats[p]:
                        r.stack.clear()
                continue
            same[p] += 1
            if same[p] >= (least := 2 if p == 1 else p):
                at, r = i - p - least, repeats[p][i % p]
                r.add(at, opens[at] + upto[at + p] - upto[at] - math.log10(p), i)
                best[i] = min(best[i], r.least(i))
        if i == n:
            break
        here = min(best[i], brute[i])
        open_ = here + (SEGMENT if i else 0.0)
        opens.append(open_)
        brute[i + 1] = min(brute[i + 1], brute[i] + chars[i], open_ + chars[i])

        def reach(j: int, cost: float, open_=open_) -> None:
            if open_ + cost < best[j]:
                best[j] = open_ + cost

        for j in range(i + 3, min(n, i + _MAX_WORD) + 1):
            if (cost := _word_cost(value[i:j], ranks)) is not None:
                reach(j, cost)
        if value[i].isdigit() and value[i].isascii():
            for k in (4, 6, 7, 8, 9, 10):
                if i + k <= n and (m := _DATE.fullmatch(value, i, i + k)):
                    days = 1 if k == 4 else 365
                    sep = any(g for g in m.groups() if g)
                    reach(i + k, math.log10(days * _YEAR_SPAN * (_SEPARATORS if sep else 1)))
    return min(best[n], brute[n])


# ---------------------------------------------------------------- spans

def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` by the base rules, in order."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def value_spans(text: str, ranks: dict[str, int]) -> list[tuple[int, int, int, float]]:
    """``(start, kind number, end, log10 guesses)`` of each credential value."""
    if not _HINT.search(text):
        return []
    return [(m.start(1), 3, m.end(1), guess_cost(m[1], ranks)) for m in CONTEXT.finditer(text)]


def corpus_ranks(df: DataFrame, text: str, size: int) -> dict[str, int]:
    """Ranks (from 1) of the ``size`` most frequent words of 3 to 20 letters
    a-z, counted over all whole texts; ties in the words' order."""
    words = df.select(F.explode(F.regexp_extract_all(
        F.lower(F.col(text).cast("string")), F.lit("(?<![a-z])[a-z]{3,20}+(?![a-z])"), 0)).alias("w"))
    counts = materialize(words.groupBy("w").agg(F.count("*").alias("n")), "secret-words")
    return {w: i for i, w in enumerate(most_frequent(counts, "w", "n", size), 1)}


_SPAN = "array<struct<kind:string,start:long,end:long,log10_guesses:double>>"


def secret_spans(df: DataFrame, key: str, text: str, ranks: dict[str, int], min_log10: float = 10.0) -> DataFrame:
    """``(key, spans, top_log10)``: every base span of every whole text, and a
    ``value`` span for each value in a credential context (name, ``:`` or
    ``=``, value) whose cheapest segmentation takes at least
    ``10**min_log10`` guesses; ``top_log10`` is the largest such cost of any
    credential value, null without one.

    Offsets are code points, ends exclusive; spans are in order of start, then
    kind as listed in ``KINDS``.  ``ranks`` (word -> rank) is broadcast; the
    caller bounds it, as :func:`corpus_ranks` does.

    Defined cases: null and empty texts have no spans; base spans stay
    whatever their cost; repeated rows each get their row; an empty table
    gives no rows; other columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    ranks_bc = df.sparkSession.sparkContext.broadcast(ranks)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                    ("log10_guesses", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranks_bc.value
        for b in slices(batches):
            rows, tops = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                values = value_spans(text, words)
                found = [(*s, None) for s in base_spans(text)] + [v for v in values if v[3] >= min_log10]
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "log10_guesses": g}
                             for s, k, e, g in sorted(found, key=lambda x: x[:3])])
                tops.append(max((v[3] for v in values), default=None))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, span_type), pa.array(tops, pa.float64())],
                                             names=["key", "spans", "top_log10"])

    return (df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(run, f"key {kind}, spans {_SPAN}, top_log10 double").withColumnRenamed("key", key))


def op9_secrets(spark: SparkSession, sf_dir: str, words: int = 20_000, min_log10: float = 10.0) -> DataFrame:
    """Secrets of all documents; word ranks come from all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secret_spans(docs, "doc_id", "text", corpus_ranks(docs, "text", words), min_log10)
    n = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    digest = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(digest(F.filter("spans", lambda s: s.kind != "value")), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"), n("value").alias("n_value"), "top_log10")


__all__ = ["guess_cost", "base_spans", "value_spans", "corpus_ranks", "secret_spans", "op9_secrets"]
