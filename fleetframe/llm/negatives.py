"""Hard negatives by segment summaries (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetframe.llm.common import materialize, table

# Fixed values of the contract: the components' scale, the number of positives
# and of negatives of each, and the least percentage of the positive's score.
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80
#: Rows scored at each level, for each one asked for.
PROBES = 8
_LONG = 2 ** 63 - 1


def _ints(column, dims: int) -> np.ndarray:
    """A column of lists of ``dims`` longs as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


class Summaries:
    """Vectors with the mean and deviation of each segment, by levels.

    Over a segment of ``n`` components ``x * y`` sums to ``n * mean_x * mean_y``
    plus the product of the centred parts, which lies within ``n * dev_x *
    dev_y`` of zero.  Both are kept times ``sqrt(n)``, so the bounds of a score
    are sums of products: ``means . means -+ deviations . deviations``.
    """

    def __init__(self, vectors: np.ndarray, widths: Sequence[int]):
        self.exact = vectors
        self.near = vectors.astype(np.float64)
        self.norms = np.sqrt((self.near * self.near).sum(axis=1))
        self.most = int(np.abs(self.near).max()) if self.near.size else 0
        self.levels = [self._level(w) for w in widths]

    def _level(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        rows, dims = self.near.shape
        means, devs = [], []
        for a in range(0, dims, width):
            part = self.near[:, a:a + width]
            mean = part.mean(axis=1)
            root = np.sqrt(part.shape[1])
            means.append(mean * root)
            devs.append(np.sqrt(((part - mean[:, None]) ** 2).mean(axis=1)) * root)
        shape = (len(means), rows)
        return (np.array(means).reshape(shape).T.copy(), np.array(devs).reshape(shape).T.copy())

    def bounds(self, level: int, rows: np.ndarray, other: "Summaries", i: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of ``rows`` with row ``i`` of ``other``."""
        (mx, dx), (my, dy) = self.levels[level], other.levels[level]
        middle, spread = mx[rows] @ my[i], dx[rows] @ dy[i]
        slack = 0.25 + 1e-10 * self.norms[rows] * other.norms[i]  # scores are whole numbers
        return middle - spread - slack, middle + spread + slack

    def scores(self, rows: np.ndarray, other: "Summaries", i: int) -> np.ndarray:
        """Exact inner products; beyond a long they are held at its ends."""
        if self.most * other.most * max(1, self.near.shape[1]) < 2 ** 53:
            return (self.near[rows] @ other.near[i]).astype(np.int64)
        wide = self.exact[rows].astype(object) @ other.exact[i].astype(object)
        return np.array([max(-_LONG, min(_LONG, int(s))) for s in wide], np.int64)


def _largest(values: np.ndarray, k: int) -> float:
    """The ``k``-th largest value, or less than all if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def best(rows: np.ndarray, ids: np.ndarray, base: Summaries, other: Summaries, i: int,
         ranges: Sequence[tuple[int, int]] | None, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each range of scores the (rows, scores) of the first ``k`` of
    ``rows`` in it; without ranges, the first ``k`` of all.

    From level to level of the summaries a row stays while, for some range, it
    may lie inside and its largest score reaches the ``k``-th best score known
    there.  Scores become known by probing: at each level the rows of the
    largest estimates are scored.  What stays after the last level is scored.
    """
    spans = [(-np.inf, np.inf)] if ranges is None else ranges
    limits = [float(lo) for lo, _ in spans]
    for level in range(len(base.levels)):
        if len(rows) <= PROBES * k:
            break
        least, most = base.bounds(level, rows, other, i)
        middle = least + most
        probed = np.argpartition(middle, len(rows) - PROBES * k)[-PROBES * k:]
        known = base.scores(rows[probed], other, i)
        stay = np.zeros(len(rows), bool)
        for j, (lo, hi) in enumerate(spans):
            limits[j] = max(limits[j], _largest(known[(known >= lo) & (known <= hi)], k))
            stay |= (most >= limits[j]) & (least <= hi)
        rows = rows[stay]
    scores = base.scores(rows, other, i)
    out = []
    for lo, hi in spans:
        pick = np.flatnonzero((scores >= lo) & (scores <= hi))
        if len(pick) > 4 * k:  # sort only what may be among the first
            pick = pick[scores[pick] >= _largest(scores[pick], k)]
        pick = pick[np.lexsort((ids[rows[pick]], -scores[pick]))][:k]
        out.append((rows[pick], scores[pick]))
    return out


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(id, label, v)``, distinct: rows with an id, a label and a vector of
    finite components, labels and components as the contract changes them."""
    raw = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                    F.col(f"`{vector}`").cast("array<double>").alias("v"))
    good = raw.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return good.select(
        "id", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("v", lambda x: F.floor(SCALE * x)).alias("v")).distinct()


def hard_negatives(df: DataFrame, key: str, vector: str, label: str, is_anchor, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, widths: Sequence[int] = (8, 2), cell_rows: int = 16_384,
                   anchor_rows: int = 8_192) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: for each row that ``is_anchor`` holds for and each of
    its ``positives`` best rows of the same label, the first ``negatives``
    rows of another label that score between 80 and 100 percent of the
    positive.  Higher scores come first, then smaller ids.

    Rows are dealt by a hash of the whole row into cells of about
    ``cell_rows``, anchors into groups of about ``anchor_rows``; a task holds
    one cell and one group, whatever a label's or an id's share of the rows.
    The work grows as anchors times rows, as the anchor set does; segment
    summaries of ``widths`` components, coarse to fine, settle most pairs, and
    the first ones of each cell are ranked by Spark.  Positives are found in a
    first pass and their ranges of scores searched in a second.

    Defined cases: rows without id, label or vector, or with null or
    non-finite components take no part; an empty vector scores 0; repeated
    rows count once, and rows that share an id are rows of their own but never
    each other's positive or negative; vectors of different lengths do not
    meet; components and scores beyond a long are held at its ends; an anchor
    without positives, or a positive of negative score, gives no rows; with
    fewer rows than asked for all are returned; an empty table gives no rows.
    """
    rows = materialize(usable(df, key, vector, label).withColumn(
        "tag", F.xxhash64("id", "label", "v")).withColumn("dims", F.size("v")), "negatives-rows")
    asked = materialize(rows.filter(is_anchor(F.col("id"))), "negatives-anchors")
    cells = max(1, -(-rows.count() // cell_rows))
    groups = max(1, -(-asked.count() // anchor_rows))
    deal = lambda n, salt: F.pmod(F.xxhash64("tag", F.lit(salt)), F.lit(n)).cast("int")
    base = rows.select("id", "label", "v", "dims", deal(cells, 1).alias("cell"),
                       F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))

    def spread(anchors: DataFrame) -> DataFrame:
        return anchors.withColumn("part", deal(groups, 2)).withColumn(
            "cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))

    def meet(find):
        def run(keys, left: pa.Table, right: pa.Table) -> pa.Table:
            dims = keys[0].as_py()
            ids, labels = left["id"].to_numpy(), left["label"].to_numpy()
            order = np.argsort(labels, kind="stable")  # the rows of a label side by side
            ids, labels = ids[order], labels[order]
            cell = Summaries(_ints(left["v"], dims)[order], widths)
            wanted = Summaries(_ints(right["v"], dims), widths)
            return find(cell, ids, labels, wanted, right)
        return run

    def same(cell, ids, labels, wanted, right):
        who, at, score = [], [], []
        for i, (a, name) in enumerate(zip(right["id"].to_pylist(), right["label"].to_pylist())):
            mine = np.arange(*np.searchsorted(labels, [name, name + 1]))
            (found, scores), = best(mine[ids[mine] != a], ids, cell, wanted, i, None, positives)
            who.append(np.full(len(found), i))
            at.append(found)
            score.append(scores)
        pick = pa.array(_joined(who))
        return pa.table({"id": right["id"].combine_chunks().take(pick), "tag": right["tag"].combine_chunks().take(pick),
                         "positive_id": pa.array(ids[_joined(at)]), "positive_score": pa.array(_joined(score))})

    def other(cell, ids, labels, wanted, right):
        who, place, at, score = [], [], [], []
        for i, (a, name, top) in enumerate(zip(right["id"].to_pylist(), right["label"].to_pylist(),
                                               right["positives"].to_pylist())):
            lo, hi = np.searchsorted(labels, [name, name + 1])
            rest = np.concatenate([np.arange(lo), np.arange(hi, len(labels))])
            # 100 * negative >= 80 * positive, in whole numbers
            spans = [(-(-LEAST_PERCENT * p["positive_score"] // 100), p["positive_score"]) for p in top]
            for j, (found, scores) in enumerate(best(rest[ids[rest] != a], ids, cell, wanted, i, spans, negatives)):
                who.append(np.full(len(found), i))
                place.append(np.full(len(found), j))
                at.append(found)
                score.append(scores)
        pick = pa.array(_joined(who))
        return pa.table({"id": right["id"].combine_chunks().take(pick), "tag": right["tag"].combine_chunks().take(pick),
                         "place": pa.array(_joined(place)), "negative_id": pa.array(ids[_joined(at)]),
                         "negative_score": pa.array(_joined(score))})

    def pairs(anchors: DataFrame, find, schema: str) -> DataFrame:
        by = ["dims", "cell", "part"]
        return base.groupBy(*by).cogroup(spread(anchors).groupBy(*by)).applyInArrow(meet(find), schema)

    def first(found: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    top = first(pairs(asked, same, "id long, tag long, positive_id long, positive_score long"),
                ["id", "tag"], "positive_score", "positive_id", positives)
    # at most `positives` in a list; those of negative score have no range
    top = materialize(top.filter("positive_score >= 0").groupBy("id", "tag").agg(F.sort_array(F.collect_list(
        F.struct("rank", "positive_id", "positive_score"))).alias("positives")), "negatives-positives")
    found = pairs(asked.join(top, ["id", "tag"]), other,
                  "id long, tag long, place long, negative_id long, negative_score long")
    ranked = first(found, ["id", "tag", "place"], "negative_score", "negative_id", negatives)
    return ranked.join(top, ["id", "tag"]).withColumn("p", F.get("positives", F.col("place").cast("int"))).select(
        F.col("id").alias("anchor_id"), F.col("p.positive_id"), "rank", "negative_id",
        F.col("p.positive_score"), "negative_score")


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.astype(np.int64) for p in parts]) if parts else np.empty(0, np.int64)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return hard_negatives(rows, "vec_id", "embedding", "label", lambda c: c % 100 == 0)


OP13_SQL = f"""
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
         ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LEAST_PERCENT} * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= {NEGATIVES}
"""

__all__ = ["Summaries", "best", "usable", "hard_negatives", "op13_negatives", "OP13_SQL"]
