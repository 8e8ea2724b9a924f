"""Best-fit-decreasing packing of token sequences (operator 6)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm.common import materialize, prefix_offsets, short_batches, slices, table
from fleetframe.llm.tokens import encoder


class CapacityTree:
    """Segment tree over remaining capacities: how many open windows have each,
    and the smallest capacity of at least ``x`` that any has."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.sums[i] += n
            i >>= 1

    def tightest(self, x: int) -> int | None:
        i = x + self.leaves
        if self.sums[i]:
            return x
        while i > 1:  # the nearest subtree to the right that has a window
            if not i & 1 and self.sums[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.leaves:
            i *= 2
            if not self.sums[i]:
                i += 1
        return i - self.leaves


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pack ``counts[length]`` items of each length into windows: the longest
    first, each into the open window with the least room that still holds it.

    Items of one length and windows of equal room are interchangeable, so
    whole runs are placed at once; the result is exactly that of placing the
    items one by one.  Work and result depend on the window, not on the
    number of items: at most one run per length and run of equal windows.

    Returns runs ``(length, first_rank, per_window, first_window, offset)``,
    ordered by length and rank: the item of rank ``first_rank + j`` lies in
    window ``first_window + j // per_window`` at ``offset + j % per_window *
    length``; a run ends where the next of its length begins.
    """
    tree, open_, runs, windows = CapacityTree(window), {}, [], 0

    def file(room: int, first: int, n: int) -> None:
        if room and n:
            open_.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        if not 1 <= length <= window:
            raise ValueError("lengths must lie between 1 and the window")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = window, window // length
                first, n = windows, -(-left // per)
                windows += n
            else:  # once filled, such a window is the tightest until it cannot hold another
                per = room // length
                first, n = open_[room].pop()
                tree.add(room, -n)
            used = min(n, -(-left // per))
            runs.append((length, rank, per, first, window - room))
            if used < n:
                file(room, first + used, n - used)
            placed = min(left, used * per)
            full = placed // per
            file(room - per * length, first, full)
            if placed % per:
                file(room - placed % per * length, first + full, 1)
            rank, left = rank + placed, left - placed
    return sorted(runs)


def _pieces(path: str, window: int, eos: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)

        def batch(keys, rows, ids):
            cols = [pa.array(keys, key_type)] + [
                pa.array([r[i] for r in rows], pa.int64()) for i in range(5)] + [
                pa.array(np.full(len(rows), part, np.int32))]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, names=[
                "key", "start", "length", "ids_crc32", "doc_tokens", "rank", "part"] + ["ids"] * with_ids)

        for b in slices(batches):
            key_type = b.schema.field(0).type
            keys, rows, ids, held = [], [], [], 0
            texts = [t or "" for t in b.column(1).to_pylist()]
            for key, body in zip(b.column(0).to_pylist(), encode(texts)):
                doc = np.append(body, np.uint32(eos)).astype("<u4")
                for start in range(0, len(doc), window):
                    piece = doc[start:start + window]
                    keys.append(key)
                    rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(doc), int(seen[len(piece)])))
                    seen[len(piece)] += 1
                    if with_ids:
                        ids.append(piece.astype(np.int32))
                        held += 4 * len(piece)
                if len(rows) >= 20_000 or held > 8 << 20:
                    yield batch(keys, rows, ids)
                    keys, rows, ids, held = [], [], [], 0
            yield batch(keys, rows, ids)
    return run


def pack(df: DataFrame, key: str, text: str, tokenizer: str, window: int = 4096, eos: int = 2,
         with_ids: bool = False) -> DataFrame:
    """Pack all texts into sequences of at most ``window`` tokens, one row per
    piece: ``key start length ids_crc32 doc_tokens sequence_id offset`` and,
    with ``with_ids``, the piece's ``ids``.

    A text's ids are followed by ``eos``; a text longer than the window is
    first cut into full windows, and the rest joins the other pieces.  The
    pieces are packed best-fit decreasing over the whole input: every task
    numbers its pieces of each length, prefix sums of the counts make the
    numbers global, the histogram of lengths (at most ``window`` rows) is
    packed by :func:`best_fit_decreasing`, and each piece finds its place by a
    join on its length and number.

    Defined cases: a null text is empty, and an empty one is the ``eos`` alone;
    null keys are kept; repeated rows are packed each; an empty table gives no
    rows; other columns are ignored.  ``tokenizer`` is the path of a
    ``tokenizers`` file on the executors.
    """
    if window < 1:
        raise ValueError("the window must hold a token")
    spark = df.sparkSession
    short_batches(spark)
    kind = df.schema[key].dataType.simpleString()
    pieces = materialize(
        df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
            _pieces(tokenizer, window, eos, with_ids),
            f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, rank long, part int"
            + ", ids array<int>" * with_ids), "pack-pieces")
    totals = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    # at most one row per possible length
    counts = {r.length: r.n for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit_decreasing(counts, window)
    ends = [nxt[1] if nxt[0] == run[0] else counts[run[0]] for run, nxt in zip(runs, [*runs[1:], (0,)])]
    # runs are filed by blocks of ranks, so that a piece meets about two; both
    # tables have some rows per run, whose number the window bounds
    block = {n: -(-counts[n] // k) for n, k in Counter(r[0] for r in runs).items()}
    blocks = F.broadcast(spark.createDataFrame(list(block.items()), "length long, block_rows long"))
    places = F.broadcast(spark.createDataFrame(
        [(*run, end, b) for run, end in zip(runs, ends)
         for b in range(run[1] // block[run[0]], (end - 1) // block[run[0]] + 1)],
        "length long, first_rank long, per_window long, first_window long, first_offset long, end_rank long, block long"))
    before = prefix_offsets(totals, "part", ["n"], by=["length"])
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("n_before") + F.col("rank"))
    at = F.col("rank") - F.col("first_rank")
    return (ranked.join(blocks, "length").withColumn("block", F.expr("rank div block_rows"))
            .join(places, ["length", "block"]).filter((at >= 0) & (F.col("rank") < F.col("end_rank")))
            .select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids,
                    (F.col("first_window") + F.expr("(rank - first_rank) div per_window")).alias("sequence_id"),
                    (F.col("first_offset") + at % F.col("per_window") * F.col("length")).alias("offset")))


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", public_tokenizer())


__all__ = ["CapacityTree", "best_fit_decreasing", "pack", "public_tokenizer", "op6_packing"]
