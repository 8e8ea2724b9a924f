"""Benchmark decontamination by a generalised suffix automaton (operator 7)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm.common import discard, materialize, schema_of, short_batches, slices, table

#: Fixed: A-Z become a-z; other ASCII but digits and a-z separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_UPPER = {c: c + 32 for c in range(65, 91)}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences, answering for a stream of
    words which fixed-length windows of the items occur, and in which items.

    A window is ``window`` consecutive words of an item; an item of fewer
    words (but not none) is one window.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        items = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for k, words in items if words]
        self.shortest = min((min(window, len(w)) for _, w in items), default=0)
        self._base = len(self.vocab) + 1
        self._build([w for _, w in items])
        self._mark(items)

    def _build(self, sequences: list[list[int]]) -> None:
        edges, link, size = [{}], [-1], [0]

        def state(length: int, out: dict, suffix: int) -> int:
            edges.append(out)
            link.append(suffix)
            size.append(length)
            return len(size) - 1

        def split(p: int, c: int) -> int:
            """The state of the string of ``p`` and ``c``, alone."""
            q = edges[p][c]
            if size[q] == size[p] + 1:
                return q
            copy = state(size[p] + 1, dict(edges[q]), link[q])
            link[q] = copy
            while p >= 0 and edges[p].get(c) == q:
                edges[p][c] = copy
                p = link[p]
            return copy

        for words in sequences:
            at = 0
            for c in words:
                if c in edges[at]:
                    at = split(at, c)
                    continue
                new = state(size[at] + 1, {}, 0)
                p = at
                while p >= 0 and c not in edges[p]:
                    edges[p][c] = new
                    p = link[p]
                if p >= 0:
                    link[new] = split(p, c)
                at = new
        self.link, self.size = link, size
        self.next = {s * self._base + c: t for s, out in enumerate(edges) for c, t in out.items()}

    def _holding(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _mark(self, items) -> None:
        self.items_of: dict[int, set] = {}     # state of a full window -> items that have it
        whole: dict[int, list] = {}            # state of a short item -> (its length, items)
        ends = []
        for key, words in items:
            state = 0
            for i, c in enumerate(words):
                state = self.next[state * self._base + c]
                if i + 1 >= self.window:
                    self.items_of.setdefault(self._holding(state, self.window), set()).add(key)
            if len(words) < self.window:
                ends.append((self._holding(state, len(words)), len(words), key))
        for state, n, key in ends:
            whole.setdefault(state, []).append((n, key))
        self.window_state = {s: self._holding(s, self.window) for s, n in enumerate(self.size) if n >= self.window}
        # short items met when a match ends in a state: its own and those of its suffixes
        self.shorts: dict[int, list] = {}
        if whole:
            for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
                if found := whole.get(s, []) + self.shorts.get(self.link[s], []):
                    self.shorts[s] = found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit ranges ``[from, to)`` of word numbers, and the items."""
        spans, found = [], set()
        if not self.shortest or len(words) < self.shortest:
            return spans, found
        ids = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int64, len(words))
        # only runs of known words that can hold a window are walked
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        starts, stops = known[::2], known[1::2]
        long = stops - starts >= self.shortest
        step, link, size, base, window = self.next, self.link, self.size, self._base, self.window
        for start, stop in zip(starts[long].tolist(), stops[long].tolist()):
            state = matched = 0
            for i, c in enumerate(ids[start:stop].tolist(), start + 1):
                to = step.get(state * base + c)
                while to is None and state:
                    state = link[state]
                    matched = size[state]
                    to = step.get(state * base + c)
                if to is None:
                    continue
                state, matched = to, matched + 1
                hit = 0
                if matched >= window:
                    hit = window
                    found |= self.items_of[self.window_state[state]]
                for n, key in self.shorts.get(state, ()):
                    if matched >= n:
                        hit = max(hit, n)
                        found.add(key)
                if hit:
                    if spans and i - hit <= spans[-1][1]:
                        # a shorter window may begin before the last range does
                        spans[-1] = (min(spans[-1][0], i - hit), i)
                    else:
                        spans.append((i - hit, i))
        return spans, found


_PASS = ("text string", "n_words long", "hits array<struct<f:long,t:long>>", "items array<string>")


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for f, t in sorted(a + b):
        if out and f <= out[-1][1]:
            out[-1] = (out[-1][0], max(t, out[-1][1]))
        else:
            out.append((f, t))
    return out


def _scan(automaton_bc, first: bool, cut: int | None):
    hits_type = pa.list_(pa.struct([("f", pa.int64()), ("t", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_bc.value
        for b in slices(batches):
            counts, hits, items, texts = [], [], [], []
            before = [([], [])] * b.num_rows if first else zip(
                [[(h["f"], h["t"]) for h in x] for x in b.column("hits").to_pylist()], b.column("items").to_pylist())
            for text, (spans, keys) in zip(b.column(1), before):
                words = normal_words(text.as_py())
                now, found = automaton.scan(words)
                counts.append(len(words))
                spans = _merge(spans, now)
                hits.append([{"f": f, "t": t} for f, t in spans])
                long = [(f, t) for f, t in spans if t - f >= cut] if cut else []
                texts.append(cut_spans(text.as_py(), long) if long else text.as_py())
                items.append(sorted(set(keys) | {k for k in found if k is not None}))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()) if cut else b.column(1), pa.array(counts, pa.int64()),
                 pa.array(hits, hits_type),
                 pa.array(items, pa.list_(pa.string()))], names=["key", "text", "n_words", "hits", "items"])
    return run


def match_items(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str,
                window: int = 13, max_words: int = 200_000, cut: int | None = None) -> DataFrame:
    """Per row of ``df``: ``key text n_words hits items``, where ``hits`` are
    merged ranges of word numbers covered by windows of the items, and
    ``items`` the sorted ids (as strings) of those whose windows occur.

    The items go into suffix automata of about ``max_words`` words each (all
    items of a benchmark table in one, as a rule); every automaton is
    broadcast in turn and the whole texts stream through it once, so neither
    the driver nor a task ever holds more of the items than that.  ``key`` may
    be a struct of all columns, to carry whole rows along.  With ``cut`` the
    texts come back without the hit ranges of at least so many words
    (``n_words`` and ``hits`` are those of the whole text).

    Defined cases: null and empty texts have no words and no hits; null and
    wordless items match nothing; an item with a null id hits but is not
    listed; repeated items and rows count as themselves; without items, or
    with an empty ``df``, nothing is hit.
    """
    spark, fields = df.sparkSession, schema_of(df.schema[key], *_PASS)
    source = items.select(F.col(item_key).cast("string").alias("k"), F.col(item_text).cast("string").alias("t"))
    size = source.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // (6 * max_words)))  # words take six bytes or so
    out, before = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), None
    short_batches(spark)
    for p in range(parts):
        mine = source.filter(F.pmod(F.xxhash64("k", "t"), F.lit(parts)) == p).collect()
        automaton = spark.sparkContext.broadcast(
            ItemAutomaton(sorted(((r.k, normal_words(r.t)) for r in mine), key=lambda x: (x[0] or "", x[1])), window))
        if p:  # one table at a time holds what is found so far
            out = materialize(out, "decontam-pass")
            discard(before)
            before = out
        out = out.mapInArrow(_scan(automaton, p == 0, cut if p == parts - 1 else None), fields)
    return out.withColumnRenamed("text", text).withColumnRenamed("key", key)


def contamination(matched: DataFrame, coverage: float = 0.05) -> DataFrame:
    """Add ``n_hit``, ``n_items`` and ``contaminated`` (hits cover at least
    ``coverage`` of the words) to :func:`match_items` output."""
    return (matched.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h.t - h.f))
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (
                F.col("n_hit") * round(1 / coverage) >= F.col("n_words"))))


def cut_spans(text: str, hits: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``hits`` and what lies between them."""
    import re
    at = [m.span() for m in re.finditer(WORD, text.translate(_UPPER))]
    out, last = [], 0
    for f, t in hits:
        out.append(text[last:at[f][0]])
        last = at[t - 1][1]
    return "".join(out) + text[last:]


def remove_spans(matched: DataFrame, text: str, coverage: float = 0.05, min_words: int = 13) -> DataFrame:
    """Add ``clean``: the text without the hit ranges of at least ``min_words``
    words, and without all hit ranges where together they reach ``coverage``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t, hits, whole in zip(b.column(text).to_pylist(), b.column("hits").to_pylist(),
                                      b.column("contaminated").to_pylist()):
                cut = [(h["f"], h["t"]) for h in hits or [] if whole or h["t"] - h["f"] >= min_words]
                out.append(cut_spans(t, cut) if cut else t)
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(out, pa.string())], names=b.schema.names + ["clean"])
    found = contamination(matched, coverage)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(run, f"{fields}, clean string")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of all documents: windows of 13 words, 5 % coverage."""
    found = contamination(match_items(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text",
                                      table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
g AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM w, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, g.n, item_id FROM g JOIN win ON g.n = win.n AND g.g = win.g),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

__all__ = ["ItemAutomaton", "match_items", "contamination", "remove_spans", "cut_spans", "op7_decontam", "OP7_SQL"]
