"""Texts that contain patterns (J8), for any number of both.

Comparing every text with every pattern is their product; a dictionary of all
patterns outgrows a task.  Instead each pattern is filed under one of its
substrings, its *anchor*, and texts and patterns meet in an equi-join:

1. a pattern's anchor has 32, 16, 8 or 4 bytes (fewer only if the pattern has),
   the longest that fits; of some evenly spread ones the anchor is the one
   that the fewest patterns share;
2. the anchors' hashes go into a Bloom filter of bounded size, built by
   segments in Spark and broadcast;
3. texts are read once: hashes of all their substrings of these lengths are
   computed on arrays and looked up in the filter; what it knows is put out as
   ``(digest of the text, hash)``, once a text;
4. these are joined with the patterns on the hash and with the texts on the
   digest, and ``contains`` decides, so neither hashes nor filter show in the
   result.  Spark splits frequent keys on both joins.

Patterns stay in Spark throughout; only the filter passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.operators.sizing import spread
from fleetframe.session import materialize

LENGTHS = (32, 16, 8, 4, 3, 2, 1)
OFFSETS = 8            # anchors looked at in a pattern
PROBES = 4             # bits of the filter per anchor
SEGMENT_BITS = 19
MOST_BITS = 29         # 64 MiB
SLICE = 1 << 18        # bytes of a text in work at a time
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _windows(data: np.ndarray) -> dict[int, np.ndarray]:
    """For each of the lengths the hash of every window of so many bytes."""
    h = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD[0])}
    for a, b in ((1, 1), (2, 1), (2, 2), (4, 4), (8, 8), (16, 16)):
        if len(data) < a + b:
            break
        left, right = h[a], h[b]
        n = len(data) - a - b + 1
        x = (left[:n] ^ (left[:n] >> np.uint64(31))) * np.uint64(_ODD[1]) + right[a:a + n]
        h[a + b] = x * np.uint64(_ODD[2] + 2 * (a + b))
    return h


def _bit(hashes: np.ndarray, size: int, probe: int) -> np.ndarray:
    """The bit of the filter that each hash has in a probe."""
    step = (hashes * np.uint64(_ODD[1])) >> np.uint64(64 - size) | np.uint64(1)
    return ((hashes >> np.uint64(64 - size)) + np.uint64(probe) * step) & np.uint64((1 << size) - 1)


def _known(hashes: np.ndarray, bitmap: np.ndarray, size: int) -> np.ndarray:
    for probe in range(PROBES):
        bit = _bit(hashes, size, probe)
        hashes = hashes[(bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return hashes


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns -> some of their windows of the longest length that fits."""
    for b in batches:
        rows, at, found, lengths = [], [], [], []
        for i, p in enumerate(b.column(0).to_pylist()):
            data = np.frombuffer(p.encode(), np.uint8)
            q = next(q for q in LENGTHS if q <= len(data))
            places = np.unique(np.linspace(0, len(data) - q, OFFSETS).astype(np.int64))
            for o in places.tolist():
                rows.append(i)
                at.append(o)
                found.append(_windows(data[o:o + q])[q][0])
                lengths.append(q)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(rows, pa.int64())), pa.array(np.array(found, np.uint64).view(np.int64)),
             pa.array(lengths, pa.int32()), pa.array(at, pa.int64())], names=["p", "h", "q", "at"])


def _anchored(patterns: DataFrame) -> DataFrame:
    """``(p, h, q)``: every distinct pattern with its anchor's hash and length."""
    windows = materialize(patterns.mapInArrow(_anchors, "p string, h long, q int, at long"), "contains-windows")
    shared = windows.groupBy("h").agg(F.count("*").alias("n"))
    best = windows.join(shared, "h").groupBy("p").agg(F.min_by(F.struct("h", "q"), F.struct("n", "at")).alias("a"))
    return materialize(best.select("p", "a.h", "a.q"), "contains-anchors")


def _filter(anchors: DataFrame, bits: int | None) -> tuple[int, np.ndarray]:
    """The Bloom filter of the anchors and the logarithm of its size."""
    keys = anchors.select("h").distinct()
    if bits is None:
        bits = min(MOST_BITS, max(16, (32 * keys.count()).bit_length()))
    segment = min(bits, SEGMENT_BITS)

    def probes(batches):
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([_bit(h, bits, j) for j in range(PROBES)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> segment).astype(np.int32)),
                                              pa.array(at & ((1 << segment) - 1))], names=["part", "bit"])

    def build(table: pa.Table) -> pa.Table:
        part = np.zeros(1 << segment, np.uint8)
        part[table["bit"].to_numpy()] = 1
        return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(part, bitorder="little").tobytes()])})
    parts = keys.mapInArrow(probes, "part int, bit long").distinct().groupBy("part").applyInArrow(
        build, "part int, bits binary").toArrow()  # bounded by the filter's size
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for i, data in zip(parts["part"].to_pylist(), parts["bits"].to_pylist()):
        bitmap[i << segment - 3:(i + 1) << segment - 3] = np.frombuffer(data, np.uint8)
    return bits, bitmap


def _scan(state, lengths: list[int], bits: int):
    """Texts -> their digest with each anchor hash that the filter knows."""
    longest = max(lengths, default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = state.value
        for b in batches:
            rows, found = [], []
            for i, text in enumerate(b.column(1)):
                data, mine = np.frombuffer((text.as_py() or "").encode(), np.uint8), []
                for at in range(0, len(data), SLICE):
                    hashes = _windows(data[at:at + SLICE + longest - 1])
                    mine += [_known(hashes[q][:SLICE], bitmap, bits) for q in lengths if q in hashes]
                if mine:
                    mine = np.unique(np.concatenate(mine))
                    rows.append(np.full(len(mine), i))
                    found.append(mine)
                if sum(map(len, found)) > 100_000:
                    yield batch(b, rows, found)
                    rows, found = [], []
            yield batch(b, rows, found)

    def batch(b, rows, found):
        at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        h = np.concatenate(found) if found else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(h.view(np.int64))],
                                          names=["digest", "h"])
    return run


def hits(df: DataFrame, columns: Sequence[str], text: str, patterns: DataFrame, pattern: str,
         filter_bits: int | None = None) -> DataFrame:
    """``columns`` as a struct ``_ff_row`` with each distinct pattern
    ``_ff_pat`` that ``text`` contains.

    Null texts and patterns match nothing, an empty pattern every text that is
    not null.  ``filter_bits`` sets the logarithm of the filter's size; by
    default it follows the number of patterns, up to 64 MiB.
    """
    every = patterns.select(F.col(pattern).cast("string").alias("p")).filter("p is not null").distinct()
    anchors = _anchored(every.filter("p != ''"))
    bits, bitmap = _filter(anchors, filter_bits)
    lengths = sorted(r.q for r in anchors.select("q").distinct().collect())  # seven at most
    body = F.col(text).cast("string")
    digest = F.unhex(F.md5(body.cast("binary")))
    known = df.sparkSession.sparkContext.broadcast(bitmap)
    seen = spread(df.select(digest.alias("digest"), body.alias("text")).filter("text is not null")).mapInArrow(
        _scan(known, lengths, bits), "digest binary, h long")
    pairs = materialize(seen.distinct().join(anchors.select("h", "p"), "h").select(
        F.col("digest").alias("_ff_of"), F.col("p").alias("_ff_pat")), "contains-pairs")
    rows = df.select(F.struct(*columns).alias("_ff_row"), body.alias("_ff_text"))
    found = rows.withColumn("_ff_digest", F.unhex(F.md5(F.col("_ff_text").cast("binary")))).join(
        pairs, F.col("_ff_digest") == F.col("_ff_of")).filter(F.col("_ff_text").contains(F.col("_ff_pat")))
    empty = rows.filter("_ff_text is not null").crossJoin(every.filter("p = ''").select(F.col("p").alias("_ff_pat")))
    return found.select("_ff_row", "_ff_pat").unionByName(empty.select("_ff_row", "_ff_pat"))


__all__ = ["hits"]
