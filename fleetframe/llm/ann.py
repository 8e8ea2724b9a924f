"""Nearest neighbours by adaptive dimension scans in probed lists (operator 3)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetframe.llm.common import materialize, table


def _matrix(column) -> np.ndarray:
    """A column of equally long float lists as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _even(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which is exact and leaves cosines as they
    are, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x


def _unit(x: np.ndarray) -> np.ndarray:
    x = _even(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means on the (unit) sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(sample, len(sample) // 8192 + 1)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


@dataclass
class Plan:
    """Where each list's rows go: a cell holds about ``cell_rows`` rows, several
    small lists or one of the parts of a large list."""
    centres: np.ndarray
    first: np.ndarray      # first cell of each list
    parts: np.ndarray      # number of cells that share it
    sizes: np.ndarray

    @classmethod
    def of(cls, centres: np.ndarray, sizes: np.ndarray, cell_rows: int) -> "Plan":
        first, parts, cell, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
        for i, n in enumerate(sizes.tolist()):
            if n > cell_rows:
                cell += held > 0
                first[i], parts[i], held = cell, -(-n // cell_rows), 0
                cell += int(parts[i])
                continue
            if held + n > cell_rows:
                cell, held = cell + 1, 0
            first[i] = cell
            held += n
        return cls(centres, first, parts, sizes)

    def probes(self, unit: np.ndarray, share: float, least: int, k: int) -> list[np.ndarray]:
        """The lists each query looks into, nearest first: a share of all, at
        least ``least``, and on until they hold more than ``k`` rows."""
        order = np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")
        n = max(least, math.ceil(share * len(self.centres)))
        held = np.cumsum(self.sizes[order], axis=1)
        return [o[:max(n, int(np.searchsorted(h, k, "right")) + 1)] for o, h in zip(order, held)]


class ColumnBlocks:
    """Rotated unit vectors stored by blocks of dimensions."""

    def __init__(self, rotated: np.ndarray, width: int):
        dims = rotated.shape[1]
        self.cuts = [(a, min(a + width, dims)) for a in range(0, dims, width)]
        self.blocks = [np.ascontiguousarray(rotated[:, a:b]) for a, b in self.cuts]
        self.dims = dims

    def scan(self, lo: int, hi: int, query: np.ndarray, limit: float, eps: float) -> np.ndarray:
        """Rows in ``[lo, hi)`` that the test does not abandon.

        After ``d`` of ``D`` rotated dimensions the partial squared distance
        times ``D / d`` estimates the whole; a row is given up when it exceeds
        ``limit * (1 + eps / sqrt(d))**2`` (the hypothesis that the row is
        within the limit is rejected); after all dimensions the distance is
        known and compared as it is.
        """
        alive, partial = np.arange(lo, hi), np.zeros(hi - lo)
        for (a, b), block in zip(self.cuts, self.blocks):
            diff = (block[lo:hi] if len(alive) == hi - lo else block[alive]) - query[a:b]
            partial += np.einsum("ij,ij->i", diff, diff)
            if limit < math.inf:
                slack = limit * (b / self.dims) * (1 + eps / math.sqrt(b)) ** 2 if b < self.dims else limit + 1e-9
                keep = partial <= slack
                alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        return alive


def search_cell(ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, turn: np.ndarray, queries, k: int,
                width: int, eps: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(query id, ids, cosines)`` of the nearest rows of one cell.

    ``queries`` yields (id, original vector, lists to probe nearest first).
    The limit is the ``k``-th largest cosine found so far; what survives a
    scan is measured on the original vectors in double precision.
    """
    vectors = _even(vectors)
    order = np.lexsort((ids, lists))
    ids, vectors, lists = ids[order], vectors[order], lists[order]
    same = np.concatenate(([False], (ids[1:] == ids[:-1]) & (lists[1:] == lists[:-1]) & (
        vectors[1:] == vectors[:-1]).all(axis=1)))  # repeated rows count once
    ids, vectors, lists = ids[~same], vectors[~same], lists[~same]
    blocks = ColumnBlocks(_unit(vectors) @ turn, width)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    names, starts = np.unique(lists, return_index=True)
    bounds = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(lists)])))
    for qid, vector, probes in queries:
        vector = _even(vector[None, :])[0]
        spun = (_unit(vector[None, :]) @ turn)[0]
        size = math.sqrt((vector * vector).sum())
        top_ids, top, limit = np.empty(0, np.int64), np.empty(0), math.inf
        for p in probes:
            if p not in bounds:
                continue
            rows = blocks.scan(*bounds[p], spun, limit, eps)
            rows = rows[ids[rows] != qid]
            if not len(rows):
                continue
            cosine = (vectors[rows] * vector).sum(axis=1) / (norms[rows] * size)
            top_ids, top = np.concatenate([top_ids, ids[rows]]), np.concatenate([top, cosine])
            best = np.lexsort((top_ids, -top))[:k]
            top_ids, top = top_ids[best], top[best]
            if len(top) == k:
                limit = max(0.0, 2 - 2 * float(top[-1]))
        if len(top):
            yield qid, top_ids, top


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, v)`` of the rows that take part: an id, and a vector
    without null or non-finite components that is not zero."""
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, key: str, vector: str, is_query, k: int = 5, share: float = 0.65, least: int = 32,
            max_lists: int = 512, sample_per_list: int = 64, cell_rows: int = 16_384, query_rows: int = 262_144,
            width: int = 16, eps: float = 2.1, seed: int = 11) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query``
    holds for, the ``k`` nearest other rows found, by cosine (double, on the
    vectors as given), ties to the smaller id.

    All rows are indexed: their list is the nearest of ``sqrt(n)`` (at most
    ``max_lists``) centroids, fitted on a hashed sample of about
    ``sample_per_list`` rows a list (at most 32,768 rows by default).  Lists
    are packed into cells of about ``cell_rows`` rows, and a list that is
    larger is split over several, so a task holds one cell however many
    vectors resemble each other; queries go to every cell that holds one of
    their ``share`` nearest lists, in groups of about ``query_rows``.  Inside
    a cell rotated vectors are scanned by column blocks and given up early
    (:meth:`ColumnBlocks.scan`); recall is set by ``share``, ``least`` and
    ``eps``.

    Vectors of each length are indexed on their own, one plan a length, and
    have neighbours of their length only.

    Defined cases: rows without id, and vectors that are null, zero or with
    null or non-finite components take no part; a query is never its own neighbour, nor are rows with its id;
    repeated rows count once; with fewer than ``k`` others all are returned;
    an empty table gives no rows.
    """
    rows = usable(df, key, vector)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("total")).orderBy("n").collect()  # few
    if not lengths:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, [
        _nearest_of(rows.filter(F.size("v") == r.n), r.n, r.total, is_query, k, share, least, max_lists,
                    sample_per_list, cell_rows, query_rows, width, eps, seed) for r in lengths])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _nearest_of(rows: DataFrame, dims: int, total: int, is_query, k: int, share: float, least: int, max_lists: int,
                sample_per_list: int, cell_rows: int, query_rows: int, width: int, eps: float, seed: int) -> DataFrame:
    """What :func:`nearest` finds in each cell of the ``total`` vectors of one
    length, before the best are taken."""
    lists = max(1, min(max_lists, math.isqrt(total)))
    picked = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
                         < F.lit(min(1.0, lists * sample_per_list / total) * (1 << 30)))
    # about lists * sample_per_list rows; the limit only matters where rows share an id
    sample = _matrix(picked.select("v").limit(4 * lists * sample_per_list).toArrow().column("v"))
    if not len(sample):
        sample = np.array([rows.first().v])
    turn = rotation(dims, seed)
    centres = centroids(_unit(sample), lists, seed)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (_unit(_matrix(b.column(1))) @ centres.T).argmax(axis=1) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=["id", "v", "list"])
    filed = materialize(rows.mapInArrow(file, "id long, v array<double>, list int"), "ann-index")
    sizes = np.zeros(len(centres), np.int64)
    for r in filed.groupBy("list").count().collect():  # one row per list
        sizes[r.list] = r["count"]
    plan = Plan.of(centres, sizes, cell_rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("list").to_numpy()
            salt = (b.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(plan.first[at] + (salt.astype(np.int64) % plan.parts[at]))],
                names=["id", "v", "list", "cell"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                vectors = _matrix(part.column(1))
                row, cells, probes = [], [], []
                for i, names in enumerate(plan.probes(_unit(vectors), share, least, k)):
                    mine: dict[int, list[int]] = {}
                    for p in names.tolist():
                        for c in range(int(plan.first[p]), int(plan.first[p] + plan.parts[p])):
                            mine.setdefault(c, []).append(p)
                    row += [i] * len(mine)
                    cells += mine.keys()
                    probes += mine.values()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), part.column(1).take(pa.array(row, pa.int64())),
                     pa.array(probes, pa.list_(pa.int32())), pa.array(cells, pa.int64())],
                    names=["id", "v", "probes", "cell"])
    asked = rows.filter(is_query("id"))
    groups = max(1, -(-asked.count() // query_rows))
    base = filed.mapInArrow(deal, "id long, v array<double>, list int, cell long").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    wanted = asked.mapInArrow(ask, "id long, v array<double>, probes array<int>, cell long").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            queries = zip(right["id"].to_pylist(), _matrix(right["v"]), right["probes"].to_pylist())
            found = list(search_cell(left["id"].to_numpy(), _matrix(left["v"]), left["list"].to_numpy(), turn,
                                     queries, k, width, eps))
        ids = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
        return pa.table({"query_id": pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                                              if found else [], pa.int64()),
                         "vec_id": pa.array(ids, pa.int64()),
                         "score": pa.array(np.concatenate([f[2] for f in found]) if found else [], pa.float64())})
    return base.groupBy("cell", "part").cogroup(wanted.groupBy("cell", "part")).applyInArrow(
        meet, "query_id long, vec_id long, score double")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding",
                   lambda c: F.col(c) % 50 == 0, k=5)


__all__ = ["rotation", "centroids", "Plan", "ColumnBlocks", "search_cell", "usable", "nearest", "op3_ann"]
