"""Language of every word by a linear-chain CRF (operator 1).

A word's emission score is the sum of learned weights of its character
n-grams (those that touch the word's ends are its affixes) and of the
lexicons it is in; transitions between the labels of neighbouring words are
learned too.  Words are labelled by exact forward-backward over whole texts,
so code-switched texts get a label and a posterior for each stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetframe.llm.common import schema_of, short_batches, slices, table

ORDERS = (2, 3, 4)      # of byte n-grams, counting the space at either end
HASH_BITS = 16
BLOCK = 128
CHUNK = 1 << 19         # bytes of which n-grams are summed at a time
MAX_LABELS = 64
#: Fixed: after lower-casing, ASCII other than a-z separates words.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LEXICON_WORD = r"[\p{L}\p{M}]+"


def _buffer(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_LETTERS)


@dataclass
class Words:
    """Words of several texts in one buffer, a space before and after each."""
    data: np.ndarray
    first: np.ndarray
    last: np.ndarray          # exclusive
    text: np.ndarray          # number of the text that each word is of
    spelled: list[bytes]

    @classmethod
    def of(cls, buffers: list[bytes]) -> "Words":
        joined = b" " + b" ".join(buffers) + b"    "
        data = np.frombuffer(joined, np.uint8)
        edge = np.diff((data != 32).astype(np.int8))
        first, last = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        ends = np.cumsum([len(b) + 1 for b in buffers]) if buffers else np.empty(0, np.int64)
        return cls(data, first, last, np.searchsorted(ends, first, "right"), joined.split())


def _hashes(data: np.ndarray, order: int) -> np.ndarray:
    """A bucket for the n-gram that begins at each byte (but the last few)."""
    x = np.full(len(data) - order + 1, order, np.uint32)
    for k in range(order):
        x = (x ^ data[k:len(x) + k]) * np.uint32(16777619)
        x ^= x >> np.uint32(13)
    return (x * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)


def _ranges(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's n-grams begin: from its space to the last that ends
    at the space behind it."""
    return words.first - 1, np.maximum(words.last - order + 2, words.first - 1)


@dataclass
class Crf:
    labels: list[str]
    lexicon: dict[bytes, int] = field(default_factory=dict)   # word -> row of member
    member: np.ndarray | None = None                          # (kinds of membership, languages) 0/1
    grams: np.ndarray | None = None                           # (2**HASH_BITS, labels)
    lex: np.ndarray | None = None                             # (languages, labels)
    bias: np.ndarray | None = None
    move: np.ndarray | None = None                            # (labels, labels) log transitions
    start: np.ndarray | None = None

    def emissions(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.first), len(self.labels)))
        for order in ORDERS:
            a, b = _ranges(words, order)
            base = np.zeros(len(self.labels))  # the sum of all n-grams before the chunk
            for at in range(0, len(words.data) - order + 1, CHUNK):
                h = _hashes(words.data[at:at + CHUNK + order - 1], order)
                sums = np.empty((len(h) + 1, len(self.labels)))
                sums[0] = 0
                np.cumsum(self.grams[h], axis=0, dtype=np.float64, out=sums[1:])
                sums += base
                last = at + len(h) + 1 if at + CHUNK + order > len(words.data) else at + len(h)
                for ends, sign in ((a, -1), (b, 1)):
                    here = slice(*np.searchsorted(ends, [at, last]))
                    out[here] += sign * sums[ends[here] - at]
                base = sums[-1]
        return out + (self.member @ self.lex)[self.kinds(words)] + self.bias

    def kinds(self, words: Words) -> np.ndarray:
        get = self.lexicon.get
        return np.fromiter((get(w, 0) for w in words.spelled), np.int64, len(words.spelled))

    def marginals(self, emissions: np.ndarray, starts: np.ndarray, pairs: bool = False):
        """Posterior of each word's label (and, with ``pairs``, the summed
        posterior of label pairs and the log likelihood's normaliser).

        The words of all texts are one chain in which a text's first word does
        not depend on the one before.  The chain is cut into blocks; the
        product of a block's steps carries messages across it, so the loop
        runs over the places in a block, not over the words.
        """
        n, k = emissions.shape
        top = emissions.max(axis=1, keepdims=True)
        e = np.exp(emissions - top)
        blocks = -(-n // BLOCK)
        pad = blocks * BLOCK - n
        e = np.concatenate([e, np.ones((pad, k))]).reshape(blocks, BLOCK, k)
        begins = np.zeros(blocks * BLOCK, bool)
        begins[starts] = True
        begins[n:] = True  # the filling at the end depends on nothing
        begins = begins.reshape(blocks, BLOCK)
        step, init = np.exp(self.move), np.exp(self.start)
        whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        for t in range(BLOCK):
            whole = np.where(begins[:, t, None, None], (whole.sum(axis=2, keepdims=True) * init), whole @ step)
            whole *= e[:, t, None, :]
            whole /= whole.max(axis=(1, 2), keepdims=True)
        into, out = np.empty((blocks, k)), np.empty((blocks, k))
        a = np.full(k, 1.0 / k)
        for b in range(blocks):
            into[b] = a
            a = a @ whole[b]
            a /= a.sum()
        z = np.ones(k)
        for b in range(blocks - 1, -1, -1):
            out[b] = z
            z = whole[b] @ z
            z /= z.max()
        alpha, scale = np.empty((blocks, BLOCK, k)), np.empty((blocks, BLOCK))
        a = into
        for t in range(BLOCK):
            a = np.where(begins[:, t, None], a.sum(axis=1, keepdims=True) * init, a @ step) * e[:, t]
            scale[:, t] = a.sum(axis=1)
            a = a / scale[:, t, None]
            alpha[:, t] = a
        gamma, both, z = np.empty((blocks, BLOCK, k)), np.zeros((k, k)), out
        first = np.zeros(k)
        for t in range(BLOCK - 1, -1, -1):
            g = alpha[:, t] * z
            gamma[:, t] = g / g.sum(axis=1, keepdims=True)
            ez = e[:, t] * z
            if pairs:
                before = alpha[:, t - 1] if t else into
                inside = np.arange(blocks) * BLOCK + t < n
                real = ~begins[:, t] & inside
                p = before[:, :, None] * step * ez[:, None, :]
                p /= p.sum(axis=(1, 2), keepdims=True)
                both += p[real].sum(axis=0)
                first += gamma[:, t][begins[:, t] & inside].sum(axis=0)
            z = np.where(begins[:, t, None], (ez @ init)[:, None], ez @ step.T)
            z = z / z.max(axis=1, keepdims=True)
        gamma = gamma.reshape(-1, k)[:n]
        if not pairs:
            return gamma
        log_z = np.log(scale.reshape(-1)[:n]).sum() + top.sum()
        return gamma, both, first, log_z

    def passage(self, emissions: np.ndarray) -> np.ndarray:
        """The product of the steps into and through the words (labels before
        x labels of the last), up to a factor."""
        n, k = emissions.shape
        e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        blocks = -(-n // BLOCK)
        e = np.concatenate([e, np.ones((blocks * BLOCK - n, k))]).reshape(blocks, BLOCK, k)
        live = (np.arange(blocks * BLOCK) < n).reshape(blocks, BLOCK)
        step = np.exp(self.move)
        whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        for t in range(BLOCK):
            whole = np.where(live[:, t, None, None], whole @ step * e[:, t, None, :], whole)
            whole /= whole.max(axis=(1, 2), keepdims=True)
        total = np.eye(k)
        for b in range(blocks):
            total = total @ whole[b]
            total /= total.max()
        return total


def train(chains: list[list[tuple[str, str]]], lexicon: dict[str, list[str]], labels: list[str],
          rounds: int = 40, rate: float = 0.15, decay: float = 1e-4) -> Crf:
    """Fit by gradient ascent (Adam) on the likelihood of ``chains``: lists of
    (language, words) stretches, so that label changes occur in them."""
    k, number = len(labels), {lab: i for i, lab in enumerate(labels)}
    crf = Crf(labels)
    kinds: dict[tuple, int] = {(0,) * k: 0}
    where: dict[bytes, list[int]] = {}
    for lang, ws in lexicon.items():
        for w in ws:
            where.setdefault(w.encode(), [0] * k)[number[lang]] = 1
    crf.lexicon = {w: kinds.setdefault(tuple(m), len(kinds)) for w, m in where.items()}
    crf.member = np.array(list(kinds), float)
    crf.grams = np.zeros((1 << HASH_BITS, k), np.float32)
    crf.lex, crf.bias, crf.move, crf.start = np.zeros((k, k)), np.zeros(k), np.zeros((k, k)), np.zeros(k)
    words = Words.of([b" ".join(_buffer(t) for _, t in chain) for chain in chains])
    gold = np.array([number[lang] for chain in chains for lang, t in chain for _ in _buffer(t).split()], np.int64)
    n = len(gold)
    if not n:
        return crf
    starts = np.flatnonzero(np.concatenate(([True], words.text[1:] != words.text[:-1])))
    kind, truth = crf.kinds(words), np.eye(k)[gold]
    feature, owner = [], []
    for order in ORDERS:
        h = _hashes(words.data, order)
        a, b = _ranges(words, order)
        size = b - a
        at = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        feature.append(h[at])
        owner.append(np.repeat(np.arange(n), size))
    feature, owner = np.concatenate(feature), np.concatenate(owner)
    inner = np.ones(n, bool)
    inner[starts] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    seen_first = truth[starts].sum(axis=0)
    names = ("grams", "lex", "bias", "move", "start")
    m = {x: 0.0 for x in names}
    v = {x: 0.0 for x in names}
    for r in range(1, rounds + 1):
        gamma, both, first, _ = crf.marginals(crf.emissions(words), starts, pairs=True)
        off = truth - gamma
        grad = {"grams": np.stack([np.bincount(feature, weights=off[owner, j], minlength=1 << HASH_BITS)
                                   for j in range(k)], axis=1),
                "lex": crf.member[kind].T @ off, "bias": off.sum(axis=0), "move": seen - both,
                "start": seen_first - first}
        for x in names:
            g = grad[x] / n - decay * getattr(crf, x)
            m[x] = 0.9 * m[x] + 0.1 * g
            v[x] = 0.99 * v[x] + 0.01 * g * g
            step = rate * (m[x] / (1 - 0.9 ** r)) / (np.sqrt(v[x] / (1 - 0.99 ** r)) + 1e-8)
            setattr(crf, x, (getattr(crf, x) + step).astype(getattr(crf, x).dtype))
    return crf


def chains_from(stretches: list[tuple[str, str]], seed: int, longest: int = 5) -> list[list[tuple[str, str]]]:
    """Shuffle the stretches and join one to ``longest`` of them to a chain."""
    rng = np.random.default_rng(seed)
    order, out, at = rng.permutation(len(stretches)), [], 0
    while at < len(order):
        size = int(rng.integers(1, longest + 1))
        out.append([stretches[i] for i in order[at:at + size]])
        at += size
    return out


def lexicons(df: DataFrame, text: str, lang: str, size: int) -> dict[str, list[str]]:
    """The ``size`` most frequent words of each language of ``df`` (a bounded
    number), counted over all rows; ties in the words' order."""
    counts = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(
        F.lower(F.col(text)), F.lit(_LEXICON_WORD), 0)).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "w")  # cut to `size` in each task before the shuffle
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size)
    found: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "r").select("lang", "w").collect():
        found.setdefault(r.lang, []).append(r.w)
    return found


def fit(df: DataFrame, text: str, lang: str, key: str, sample: int = 2000, stretch: int = 40,
        lexicon: int = 1000, max_labels: int = MAX_LABELS, seed: int = 7) -> Crf:
    """Learn a :class:`Crf` from the rows of ``df`` with text and language.

    The lexicons are counted over all rows.  The weights are fitted on about
    ``sample`` rows (four times as many at most), shared out evenly over the
    languages and picked by a hash of key and text; of each, ``stretch`` words
    from a hashed place are used, so that one long text does not outweigh the
    others and the driver's memory has a bound.  Stretches are joined to
    chains across languages.  The ``max_labels`` languages of most rows (ties
    by name) are learned; transitions grow with their square.
    """
    short_batches(df.sparkSession)
    rows = df.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("lang"),
                     F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string"), F.lit(seed)).alias("h")).filter(
        F.col("t").isNotNull() & F.col("lang").isNotNull())
    totals = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(
        max_labels).collect()}
    labels = sorted(totals)
    rows = rows.filter(F.col("lang").isin(labels)) if labels else rows
    if not labels:
        return Crf([])
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample / len(labels) / totals[x]))) for x in labels])
    picked = rows.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            langs, texts = [], []
            for t, one, h in zip(*(c.to_pylist() for c in b.columns)):
                words = t.split()
                at = (h >> 30) % max(1, len(words) - stretch + 1)
                langs.append(one)
                texts.append(" ".join(words[at:at + stretch]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string())],
                                             names=["lang", "words"])
    # the limit only matters where rows share key and text, and so their hash
    got = sorted((r.lang, r.words) for r in
                 picked.mapInArrow(cut, "lang string, words string").limit(4 * sample).collect())
    return train(chains_from(got, seed), lexicons(rows, "t", "lang", lexicon), labels)


def _cut(buffer: bytes, size: int) -> list[bytes]:
    """The buffer in slices of about ``size`` bytes that end between words."""
    out, at = [], 0
    while at < len(buffer):
        to = buffer.find(b" ", at + size)
        to = len(buffer) if to < 0 else to
        out.append(buffer[at:to])
        at = to
    return out


def _label_slices(crf: Crf, buffer: bytes, size: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and posteriors of one long text, slice by slice.

    A first pass keeps of each slice only how labels before it lead to labels
    at its end; from these follow the messages into each slice and back out of
    the next, which the second pass adds to its first and last word.  The
    posteriors are those of the whole text.
    """
    def emissions(piece: bytes) -> tuple[Words, np.ndarray]:
        words = Words.of([piece])
        return words, crf.emissions(words)
    pieces = [p for p in _cut(buffer, size) if p.strip()]
    forth, through = [], []
    for i, p in enumerate(pieces):
        e = emissions(p)[1]
        if i == 0:
            a = np.exp(crf.start + e[0] - e[0].max())
            a = a @ crf.passage(e[1:]) if len(e) > 1 else a
        else:
            through.append(crf.passage(e))
            a = forth[-1] @ through[-1]
        forth.append(a / a.sum())
    back = [np.ones(len(crf.labels))]
    for w in reversed(through):
        z = w @ back[-1]
        back.append(z / z.max())
    back.reverse()
    tiny = np.finfo(float).tiny
    for i, p in enumerate(pieces):
        words, e = emissions(p)
        if i:
            e[0] += np.log(forth[i - 1] @ np.exp(crf.move) + tiny) - crf.start
        e[-1] += np.log(back[i] + tiny)
        yield words.spelled, crf.marginals(e, np.array([0]))


def label_texts(crf: Crf, texts: list[str | None], group_bytes: int | None = None
                ) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """``(number of the text, words, their label posteriors)``, in order.  A
    text longer than a group comes in several consecutive parts, so memory
    beyond its own is that of a group."""
    group_bytes = group_bytes or max(1 << 12, (1 << 20) // max(4, len(crf.labels)))
    group, size, first = [], 0, 0

    def flush():
        words = Words.of(group)
        if len(words.first):
            starts = np.flatnonzero(np.concatenate(([True], words.text[1:] != words.text[:-1])))
            gamma = crf.marginals(crf.emissions(words), starts)
        else:
            gamma = np.empty((0, len(crf.labels)))
        cuts = np.searchsorted(words.text, np.arange(len(group) + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            yield first + i, words.spelled[a:b], gamma[a:b]
    for i, t in enumerate(texts):
        buffer = _buffer(t or "")
        if size + len(buffer) > 2 * group_bytes and group:
            yield from flush()
            group, size, first = [], 0, i
        if len(buffer) > 2 * group_bytes:
            if not buffer.strip():
                yield i, [], np.empty((0, len(crf.labels)))
            else:
                yield from ((i, *part) for part in _label_slices(crf, buffer, group_bytes))
            first = i + 1
            continue
        group.append(buffer)
        size += len(buffer)
        if size > group_bytes:
            yield from flush()
            group, size, first = [], 0, i + 1
    if group:
        yield from flush()


def _add_runs(runs: list[list[int]], tags: np.ndarray) -> None:
    """Append stretches ``[tag, words]``; an equal tag goes on the last one."""
    bounds = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), len(tags)]
    for a, z in zip(bounds, bounds[1:]):
        if runs and runs[-1][0] == tags[a]:
            runs[-1][1] += z - a
        else:
            runs.append([int(tags[a]), z - a])


def identify(df: DataFrame, key: str, text: str, crf: Crf, with_words: bool = False,
             with_text: bool = False) -> DataFrame:
    """``(key, lang_pred, score)`` for every whole text; with ``with_words``
    also ``runs``: arrays of (lang, words) for each stretch of equal labels.

    ``score`` is the mean posterior of ``lang_pred`` over the words, so a text
    half in another language scores about a half.  ``key`` may be a struct of
    columns, to carry whole rows along; ``with_text`` also passes the text on,
    as ``text``.

    Defined cases: very long texts are labelled whole, slice by slice; a null
    text or one without a letter is ``und`` with score 0; so is everything if ``crf`` has no labels; ties go to the first label;
    repeated rows and null keys each get their row; an empty table gives no
    rows; other columns are ignored.
    """
    short_batches(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(crf)
    runs_type = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            preds, scores, runs = [], [], []
            found = groupby(label_texts(m, texts) if m.labels else ((i, [], None) for i in range(len(texts))),
                            key=lambda x: x[0])
            for i, parts in found:
                total, n, lettered, tags = np.zeros(len(m.labels)), 0, False, []
                for _, words, gamma in parts:
                    if not words:
                        continue
                    total, n = total + gamma.sum(axis=0), n + len(words)
                    lettered = lettered or any(w[0] < 128 for w in words)
                    if with_words:
                        _add_runs(tags, gamma.argmax(axis=1))
                if not (lettered or n and any(c.isalpha() for c in texts[i])):
                    preds.append("und")
                    scores.append(0.0)
                    runs.append([])
                    continue
                mean = total / n
                best = int(mean.argmax())
                preds.append(m.labels[best])
                scores.append(min(1.0, max(0.0, float(mean[best]))))
                if with_words:
                    runs.append([{"lang": m.labels[tag], "words": k} for tag, k in tags])
            cols = [b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            if with_words:
                cols.append(pa.array(runs, runs_type))
            if with_text:
                cols.append(b.column(1))
            yield pa.RecordBatch.from_arrays(
                cols, names=["key", "lang_pred", "score"] + ["runs"] * with_words + ["text"] * with_text)
    fields = schema_of(df.schema[key], "lang_pred string", "score double",
                       *["runs array<struct<lang:string,words:long>>"] * with_words, *["text string"] * with_text)
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, fields).withColumnRenamed("key", key)


def held_out(key: str):
    """Whether crc32 of the key as text is divisible by 5 (a null key's text
    is empty)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; learned from those not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    crf = fit(docs.filter(~held_out("doc_id")), "text", "lang", "doc_id")
    return identify(docs, "doc_id", "text", crf).select("doc_id", held_out("doc_id").alias("held_out"),
                                                        "lang_pred", "score")


__all__ = ["Crf", "train", "chains_from", "lexicons", "fit", "label_texts", "identify", "held_out", "op1_langid"]
