"""SimHash near-duplicates by multi-index hashing (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm.common import discard, materialize, schema_of, short_batches, slices, table
from fleetframe.llm.components import connected_components

HASH_SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: bit j of byte value v
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_CHUNK = 1 << 18


def simhash64(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint (unsigned): a bit is set if it is set in over
    half of the XXH64 hashes of the word shingles, repeats included."""
    import xxhash
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    del words
    n = max(1, len(ends) - shingle + 1)
    lasts = ends[-n:] if len(ends) >= shingle else ends[-1:]
    firsts = np.concatenate(([0], ends[:n - 1] + 1))
    digest, counts = xxhash.xxh64_intdigest, np.zeros((8, 8), np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[s:e], HASH_SEED) for s, e in
                      zip(firsts[at:at + _CHUNK].tolist(), lasts[at:at + _CHUNK].tolist())], "<u8")
        lanes = h.view(np.uint8).reshape(-1, 8)
        if len(h) < 400:
            counts += np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64).reshape(8, 8)
        else:
            for k in range(8):
                counts[k] += np.bincount(lanes[:, k], minlength=256) @ _BITS
    return sum(1 << i for i, c in enumerate(counts.reshape(64).tolist()) if 2 * c > n)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([simhash64(t.as_py(), shingle) for t in b.column(b.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(fps.view(np.int64))],
                                             names=b.schema.names[:-1] + ["fp"])
    return run


def fingerprints(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``(key, fp)``: the fingerprint of every whole text as a signed long."""
    short_batches(df.sparkSession)
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        _fingerprints(shingle), schema_of(df.schema[key], "fp long"))


def segment_plan(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """``(offset, width, radius)`` of each segment of the 64 bits: two
    fingerprints within ``distance`` differ by at most ``radius`` bits in at
    least one segment (pigeonhole; radius -1 leaves a segment unsearched)."""
    base, extra = divmod(distance, segments)
    plan, offset = [], 0
    for s in range(segments):
        width = 64 // segments + (s < 64 % segments)
        plan.append((offset, width, base if s <= extra else base - 1))
        offset += width
    return plan


def segments_for(n: int, distance: int, choices: tuple[int, ...] = (3, 2)) -> int:
    """The number of segments that makes ``n`` fingerprints cheapest: a probe
    costs a row, and a fiftieth more for each unrelated fingerprint it meets."""
    def cost(segments: int) -> float:
        plan = [(w, r) for _, w, r in segment_plan(distance, segments) if r >= 0]
        return sum(sum(comb(w, i) for i in range(r + 1)) * (1 + n / 50 / 2 ** w) for w, r in plan)
    return min(choices, key=cost)


def _probes(fp: Column, distance: int, segments: int) -> Column:
    """Array of index keys of one fingerprint: per segment its own value, and
    the values in the Hamming ball around it that are larger.  Of two unequal
    values in each other's ball the smaller one's ball holds the larger one,
    so every pair meets under a value that one of them has."""
    keys = []
    for s, (offset, width, radius) in enumerate(segment_plan(distance, segments)):
        if radius < 0:
            continue
        value = F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))
        tag = F.lit(s << 58)
        masks = [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(width), r)]
        own = F.array(tag.bitwiseOR(value))
        if masks:
            ball = F.filter(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]),
                                        lambda m: value.bitwiseXOR(m)), lambda v: v > value)
            own = F.concat(own, F.transform(ball, lambda v: tag.bitwiseOR(v)))
        keys.append(own)
    return F.concat(*keys)


def _forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join up all of ``fps`` within ``distance`` of each other: a
    breadth-first walk that compares each value with those not yet reached, so
    a dense group costs little more than its size and yields one link each."""
    out, rest = [], fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), x), found))
                todo.extend(found)
                rest = rest[~near]
    return out


def _match(distance: int, plan: list[tuple[int, int, int]]):
    """Sorted ``(key, sub, fp)`` rows -> links, group by group."""
    small = 48

    def own(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
        """Whether the fingerprint has the key's value itself."""
        has = np.zeros(len(keys), bool)
        for s, (offset, width, _) in enumerate(plan):
            m = (keys >> np.uint64(58)) == s
            has[m] = ((fps[m] >> np.uint64(offset)) & np.uint64((1 << width) - 1)) == (
                keys[m] & np.uint64((1 << 58) - 1))
        return has

    def links(keys, subs, fps):
        """All complete groups of the arrays."""
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1])])
        sizes = np.diff(np.r_[first, len(keys)])
        live = np.logical_or.reduceat(own(keys, fps), first) & (sizes > 1)
        out = []
        for f, n in zip(first[live & (sizes > small)].tolist(), sizes[live & (sizes > small)].tolist()):
            out += _forest(fps[f:f + n], distance)
        pick = live & (sizes <= small)
        starts, sizes = first[pick], sizes[pick]
        at = np.repeat(starts, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        left = np.repeat(starts + sizes, sizes) - at  # rows of the group from here on
        for step in range(1, small):
            keep = left > step
            at, left = at[keep], left[keep]
            if not len(at):
                break
            a, b = fps[at], fps[at + step]
            near = np.bitwise_count(a ^ b) <= distance
            out.append((a[near], b[near]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.uint64)] * 3

        def batch(pairs):
            a = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.uint64)
            b = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.uint64).view(np.int64)),
                                               pa.array(b.astype(np.uint64).view(np.int64))], names=["a", "b"])
        for rb in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in rb.columns]
            held = [np.concatenate(x) for x in zip(held, new)]
            if not len(held[0]):
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = len(last) - int(last.sum())  # the last group may go on in the next batch
            if cut:
                yield batch(links(*[x[:cut] for x in held]))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield batch(links(*held))
    return run


def hamming_links(fps: DataFrame, fp: str, distance: int, segments: int | None = None, block: int = 4096) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (longs) whose transitive
    closure joins exactly those that chains of pairs within ``distance`` bits
    join; every link is such a pair, checked over all 64 bits.

    Multi-index hashing: each fingerprint is filed under its own value of each
    segment and looks up the small Hamming ball around that value; matches are
    verified.  With 3 segments of 21 or 22 bits a lookup meets about
    ``n / 2**21`` unrelated fingerprints; by default the number of segments
    follows the number of distinct fingerprints (:func:`segments_for`).  A value met by more than ``block`` rows is cut
    into blocks and every pair of its blocks becomes one group, so no task
    holds more than about ``2 * block`` rows of a group; inside a group a
    breadth-first walk yields at most one link a row instead of all pairs.
    """
    distinct = materialize(fps.select(F.col(fp).alias("fp")).filter("fp is not null").distinct(), "simhash-distinct")
    segments = segments or segments_for(distinct.count(), distance)
    plan = segment_plan(distance, segments)
    rows = distinct.select("fp", F.explode(_probes(F.col("fp"), distance, segments)).alias("key"))
    # one row per value that is met often; most collections have none
    hot = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
                      .select(F.col("key").alias("hot_key"),
                              F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-hot")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    subs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                    lambda j: (F.least(mine, j).cast("long") * F.col("blocks") + F.greatest(mine, j))))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.join(hot, F.col("key") == F.col("hot_key"), "left")
             .select("key", F.explode(subs).alias("sub"), "fp")
             .repartition(n, "key", "sub").sortWithinPartitions("key", "sub"))
    return dealt.mapInArrow(_match(distance, plan), "a long, b long")


def simhash_groups(df: DataFrame, key: str, text: str, shingle: int = 4, distance: int = 4,
                   segments: int | None = None) -> DataFrame:
    """``(key, fp, root, component_id)`` for every row of ``df``.

    Words are runs without ASCII white space after lower-casing A-Z; the
    fingerprint is the per-bit majority of the XXH64 hashes (seed 42) of the
    ``shingle``-word shingles.  Fingerprints within ``distance`` bits link;
    ``component_id`` is the smallest key that links reach, ``root`` the
    smallest fingerprint (signed) in the component.

    Equal fingerprints are joined up first, so copies cost one row each.

    Defined cases: null, empty and white-space texts have fingerprint 0 and
    link like any other; a text of fewer words than a shingle is one shingle;
    repeated rows each get their row; a null key is passed over as
    ``component_id`` unless all keys of the component are null; an empty table
    gives no rows; other columns of ``df`` are ignored.
    """
    marked = materialize(fingerprints(df, key, text, shingle), "simhash-marked")
    nodes = connected_components(hamming_links(marked, "fp", distance, segments), "a", "b")
    least = marked.groupBy("fp").agg(F.min("key").alias("least"))
    rooted = materialize(least.join(nodes, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.select("fp", "root").join(ids, "root"), "simhash-classes")
    discard(rooted)
    # both sides are scans: a fingerprint that many rows share is split
    return marked.join(classes, "fp").select(F.col("key").alias(key), "fp", "root", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 4-word shingles, 4 bits."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash_groups(docs, "doc_id", "text", shingle=4, distance=4).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


__all__ = ["simhash64", "fingerprints", "segment_plan", "hamming_links", "simhash_groups", "op5_simhash"]
