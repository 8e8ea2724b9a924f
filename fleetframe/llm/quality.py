"""Document quality by co-training two views (operator 8).

The text view sees only the text, the metadata view only the other columns.
Each is a logistic regression on hashed features.  In every round both score
all documents; confident scores of one view become labels for the other.  At
the end the calibrated views are combined and all documents scored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetframe.llm.common import materialize, schema_of, slices, table

WORD_BITS = 14
META_BITS = 10
_STATS = 14
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TEXT_SIZE, META_SIZE = (1 << WORD_BITS) + _STATS, (1 << META_BITS) + 1
Features = tuple[np.ndarray, np.ndarray]


def text_features(text: str | None) -> Features:
    """Hashed words (log counts, divided by the root of their length, so that
    a word weighs less in a long text but does not vanish) and statistics."""
    data = (text or "").encode("utf-8", "replace")
    words = data.translate(_LETTERS).split()
    counts = Counter(words)
    idx = np.fromiter((zlib.crc32(w) & ((1 << WORD_BITS) - 1) for w in counts), np.int64, len(counts))
    val = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(val):
        val /= float(val @ val) ** 0.25
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(1, len(data))
    lines = data.split(b"\n")
    n = max(1, len(words))
    stats = np.array([
        1.0, byte[97:123].sum(), byte[65:91].sum(), byte[48:58].sum(), byte[32] + byte[9], byte[10] * 10,
        byte[33:48].sum() * 5, byte[58:65].sum() * 5, byte[91:97].sum() * 5 + byte[123:128].sum() * 5,
        byte[128:].sum(), len(counts) / n, len(set(lines)) / len(lines), sum(map(len, words)) / n / 10,
        math.log1p(len(words)) / 10])
    return np.concatenate([idx, (1 << WORD_BITS) + np.arange(_STATS)]), np.concatenate([val, stats])


def meta_features(names: list[str], values: list) -> Features:
    """One hashed indicator per column: its value, or for numbers the half
    power of two that it lies in."""
    idx = [1 << META_BITS]
    for name, v in zip(names, values):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            v = "inf" if not math.isfinite(v) else math.copysign(math.floor(2 * math.log2(1 + abs(v))), v)
        idx.append(zlib.crc32(f"{name}={v}".encode("utf-8", "replace")) & ((1 << META_BITS) - 1))
    return np.array(idx, np.int64), np.ones(len(idx))


class Logistic:
    """Logistic regression on sparse weighted rows, fitted by full-batch Adam."""

    def __init__(self, size: int):
        self.w = np.zeros(size)
        self.a, self.b = 1.0, 0.0    # Platt scaling

    def fit(self, rows: list[Features], y: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.1,
            decay: float = 1e-2) -> None:
        idx, val, owner = _flat(rows)
        self.w = np.zeros(len(self.w))
        m, v, total = np.zeros_like(self.w), np.zeros_like(self.w), weight.sum()
        for t in range(1, rounds + 1):
            p = _sigmoid(np.bincount(owner, self.w[idx] * val, len(rows)))
            g = np.bincount(idx, ((p - y) * weight / total)[owner] * val, len(self.w)) + decay * self.w / len(rows) ** 0.5
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)

    def margin(self, row: Features) -> float:
        return float(self.w[row[0]] @ row[1])

    def log_odds(self, row: Features) -> float:
        return self.a * self.margin(row) + self.b

    def calibrate(self, rows: list[Features], y: np.ndarray, weight: np.ndarray) -> None:
        self.a, self.b = platt(np.array([self.margin(r) for r in rows]), y, weight)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _flat(rows: list[Features]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]),
            np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the log odds, by Newton steps on smoothed targets."""
    if not len(y):
        return 1.0, 0.0
    weight = np.ones(len(y)) if weight is None else weight
    up, down = ((weight * y).sum() + 1) / ((weight * y).sum() + 2), 1 / ((weight * (1 - y)).sum() + 2)
    target, x = np.where(y > 0.5, up, down), np.stack([margin, np.ones(len(y))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        g = x.T @ (weight * (p - target)) + 1e-3 * (w - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


@dataclass
class Model:
    """Both views of one target, and how they combine."""
    text: Logistic = field(default_factory=lambda: Logistic(TEXT_SIZE))
    meta: Logistic = field(default_factory=lambda: Logistic(META_SIZE))
    prior: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def both(self, text: Features, meta: Features) -> tuple[float, float, float]:
        t, m = self.text.log_odds(text), self.meta.log_odds(meta)
        return (float(_sigmoid(t)), float(_sigmoid(m)), float(_sigmoid(self.a * (t + m - self.prior) + self.b)))


def train(labelled: list[tuple[Features, Features, float, bool, float]],
          pseudo_text: list[tuple[Features, float]], pseudo_meta: list[tuple[Features, float]],
          pseudo_weight: float = 0.5) -> Model:
    """Fit both views on (text, metadata, label, for calibration, weight) rows
    and the labels that the other view gave; calibrate on the rows set apart.
    A weight says how many rows of the corpus a row stands for."""
    model = Model()
    fit_rows = [r for r in labelled if not r[3]] or labelled
    check = [r for r in labelled if r[3]] or labelled
    if not fit_rows:
        return model
    mean = sum(r[4] for r in labelled) / len(labelled)
    y, weight = np.array([r[2] for r in check]), np.array([r[4] / mean for r in check])
    p = ((weight * y).sum() + 1) / (weight.sum() + 2)
    model.prior = math.log(p / (1 - p))
    for view, at, extra in ((model.text, 0, pseudo_text), (model.meta, 1, pseudo_meta)):
        view.fit([r[at] for r in fit_rows] + [r for r, _ in extra],
                 np.array([r[2] for r in fit_rows] + [v for _, v in extra]),
                 np.array([r[4] / mean for r in fit_rows] + [pseudo_weight] * len(extra)))
        view.calibrate([r[at] for r in check], y, weight)
    joint = np.array([model.text.log_odds(r[0]) + model.meta.log_odds(r[1]) - model.prior for r in check])
    model.a, model.b = platt(joint, y, weight)
    return model


_SPARSE = "array<int>", "array<double>"


def _featurize(names: list[str]):
    """(key, text, metadata...) rows -> key and the features of both views."""
    ints, floats = pa.list_(pa.int32()), pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            metas = list(zip(*(c.to_pylist() for c in b.columns[2:]))) if names else [()] * b.num_rows
            rows = [(*text_features(t.as_py()), *meta_features(names, m)) for t, m in zip(b.column(1), metas)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[i] for r in rows], ints if i % 2 == 0 else floats) for i in range(4))],
                names=["key", "ti", "tv", "mi", "mv"])
    return run


def _score(models_bc, targets: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = models_bc.value
        for b in slices(batches):
            metas = list(zip(*(c.to_pylist() for c in b.columns[2:]))) if names else [()] * b.num_rows
            out = [[] for _ in range(3 * len(targets))]
            for t, m in zip(b.column(1), metas):
                text, meta = text_features(t.as_py()), meta_features(names, m)
                for i, target in enumerate(targets):
                    for j, p in enumerate(models[target].both(text, meta)):
                        out[3 * i + j].append(p)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, pa.float64()) for o in out)],
                                             names=["key", *(f"{t}_{v}" for t in targets for v in ("text", "meta", "both"))])
    return run


def _totals(df: DataFrame, by: list[str]) -> dict[tuple, int]:
    """Rows per value of ``by``."""
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*by).agg(F.count("*")).collect()}  # a row per value


def _pick(df: DataFrame, by: list[str], bound: int, seed: int, totals: dict[tuple, int] | None = None) -> DataFrame:
    """About ``bound`` rows of a keyed table, shared out evenly over the values
    of ``by`` and chosen by a hash of the key."""
    totals = _totals(df, by) if totals is None else totals
    if not totals:
        return df.limit(0)
    cases = [F.when(F.struct(*[F.col(c) for c in by]) == F.struct(*[F.lit(x) for x in value]),
                    F.lit(min(1.0, bound / len(totals) / n))) for value, n in totals.items()]
    return df.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < F.coalesce(*cases) * (1 << 30))


def cotrain(df: DataFrame, key: str, text: str, metadata: list[str], labels: DataFrame, label_key: str,
            targets: list[str], rounds: int = 2, sample: int = 12_000, pseudo: int = 2000, confident: float = 0.95,
            seed: int = 3) -> DataFrame:
    """``(key, {target}_text, {target}_meta, {target}_both)`` for every row:
    calibrated probabilities of each 0/1 target by either view and combined.

    The views are fitted on about ``sample`` labelled rows (a quarter set
    apart for calibration), shared out evenly over the combinations of labels
    and weighted back to the combinations' totals, and, in each round, about ``pseudo`` labels a view
    and target picked by hash from all unlabelled rows that the other view is
    ``confident`` about; every round scores the whole table to find them.

    Defined cases: null and empty texts have no words; null metadata is a
    value of its own; several labels of a key count by their mean (at least a
    half is 1); null labels and keys without a row are passed over; rows with
    a null key are scored; without labels every probability is a half;
    repeated rows each get their row; an empty table gives no rows.
    """
    spark = df.sparkSession
    numeric = (T.NumericType,)
    meta = [F.col(c) if isinstance(df.schema[c].dataType, numeric) and not isinstance(df.schema[c].dataType, T.DecimalType)
            else F.col(c).cast("string") for c in metadata]
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"),
                     *[m.alias(f"m{i}") for i, m in enumerate(meta)])
    known = materialize(labels.filter(F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("key")).agg(
        *[(F.avg(t) >= 0.5).cast("int").alias(f"y{i}") for i, t in enumerate(targets)]), "quality-labels")
    ys = [f"y{i}" for i in range(len(targets))]
    fields = schema_of(df.schema[key], "ti array<int>", "tv array<double>", "mi array<int>", "mv array<double>")

    def gather(picked: DataFrame) -> list[dict]:
        """Features of a bounded number of picked keys, once a key."""
        found = rows.join(F.broadcast(picked.select("key")), "key", "left_semi").select(
            *rows.columns).dropDuplicates(["key"])
        made = found.mapInArrow(_featurize(metadata), fields)
        got = made.join(F.broadcast(picked), "key").toArrow()  # bounded by `sample` or `pseudo`
        plain = got.drop_columns(["ti", "tv", "mi", "mv"]).to_pylist()
        lists = {}
        for c in ("ti", "tv", "mi", "mv"):
            column = got[c].combine_chunks()
            flat, at = column.flatten().to_numpy(), column.offsets.to_numpy()
            lists[c] = [flat[a:b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
        out = [r | {"t": (lists["ti"][i], lists["tv"][i]), "m": (lists["mi"][i], lists["mv"][i])}
               for i, r in enumerate(plain)]
        return sorted(out, key=lambda r: repr(r["key"]))

    judged = known.na.drop(subset=ys, how="all")
    totals = _totals(judged, ys)
    picked = _pick(judged, ys, sample, seed, totals)
    # what a picked row stands for, counted before keys without a document go
    weight = {value: totals[value] / n for value, n in _totals(picked, ys).items()} if totals else {}
    seen = gather(picked)
    labelled = [[(r["t"], r["m"], float(r[y]), zlib.crc32(repr(r["key"]).encode()) % 4 == 0,
                  weight[tuple(r[c] for c in ys)])
                 for r in seen if r[y] is not None] for y in ys]
    models = {t: train(rows_, [], []) for t, rows_ in zip(targets, labelled)}
    out = schema_of(df.schema[key], *[f"{t}_{v} double" for t in targets for v in ("text", "meta", "both")])

    def scored() -> DataFrame:
        return rows.mapInArrow(_score(spark.sparkContext.broadcast(models), targets, metadata), out)
    for r in range(rounds if seen else 0):
        now = materialize(scored().join(known.select("key"), "key", "left_anti").filter("key is not null"),
                          "quality-scores")
        models = dict(models)
        for t, rows_ in zip(targets, labelled):
            given = {}
            for teacher in ("text", "meta"):
                sure = now.select("key", (F.col(f"{t}_{teacher}") >= 0.5).cast("int").alias("y"),
                                  F.abs(F.col(f"{t}_{teacher}") - 0.5).alias("d")).filter(F.col("d") >= confident - 0.5)
                given[teacher] = gather(_pick(sure.groupBy("key").agg(F.max("y").alias("y")), ["y"], pseudo, seed + r))
            models[t] = train(rows_, [(g["t"], float(g["y"])) for g in given["meta"]],
                              [(g["m"], float(g["y"])) for g in given["text"]])
    return scored().withColumnRenamed("key", key)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, and toxicity by the same method; ``keep`` if
    the document is likely of good quality and not toxic."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    found = cotrain(docs, "doc_id", "text", ["lang", "source", "n_chars"], table(spark, sf_dir, "labels"), "doc_id",
                    ["quality", "toxic"])
    return found.select("doc_id", F.col("quality_both").alias("quality_score"), F.col("quality_text").alias("text_score"),
                        F.col("quality_meta").alias("meta_score"), F.col("toxic_both").alias("toxic_score"),
                        ((F.col("quality_both") >= 0.5) & (F.col("toxic_both") < 0.5)).alias("keep"))


__all__ = ["text_features", "meta_features", "Logistic", "platt", "train", "cotrain", "op8_quality"]
