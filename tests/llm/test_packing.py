import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from fleetframe.llm.packing import CapacityTree, best_fit_decreasing, op6_packing, pack, public_tokenizer
from fleetframe.llm.tokens import Encoder
from tests.conftest import SF_SMALL


def one_by_one(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, -i) for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[-min(fit)[1]] -= n
        else:
            rooms.append(window - n)
    return sorted(rooms)


def test_runs_equal_one_by_one():
    rng = random.Random(6)
    for _ in range(60):
        window = rng.choice([1, 7, 16, 50, 64])
        lengths = [rng.randrange(1, window + 1) for _ in range(rng.randrange(0, 150))]
        if rng.random() < 0.3:
            lengths += [rng.randrange(1, window + 1)] * 70
        counts = Counter(lengths)
        runs = best_fit_decreasing(counts, window)
        used, placed = {}, Counter()
        for i, (length, rank, per, first, offset) in enumerate(runs):
            last = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
            for j in range(last - rank):
                used.setdefault(first + j // per, []).append((offset + j % per * length, length))
                placed[length] += 1
        assert placed == counts
        for pieces in used.values():
            at = 0
            for o, n in sorted(pieces):
                assert o == at
                at += n
            assert at <= window
        assert sorted(used) == list(range(len(used)))
        assert sorted(window - sum(n for _, n in p) for p in used.values()) == one_by_one(lengths, window)


def test_tree():
    rng, tree, have = random.Random(1), CapacityTree(100), Counter()
    for _ in range(500):
        c = rng.randrange(0, 101)
        have[c] += 1
        tree.add(c, 1)
        if rng.random() < 0.6:
            c = rng.choice([k for k, n in have.items() if n])
            have[c] -= 1
            tree.add(c, -1)
        x = rng.randrange(0, 101)
        assert tree.tightest(x) == min((k for k, n in have.items() if n and k >= x), default=None)


def test_encoder_equals_tokenizer(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    texts += ["", " ", "don't WE'LL 'S !'s it''s", "a<|endoftext|>b", "İstanbul ﬁ J̌ Ω ① ٣ 漢字  x\u0085y", "É" * 500,
              "x" * 5000, "12 345 6.7 ±½ ª º ŉ ſ", "a\tb\nc\x0bd\x1fe", "é \U0001f600"]
    plain = Tokenizer.from_file(public_tokenizer())
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    rng = random.Random(5)
    signs = ["'s", "'", "'ll", "'LL", "it", "'t", "!", "'re", "ve", "'v", " ", "9", "'9", "é", "'d", "''", "x"]
    texts += ["".join(rng.choices(signs, k=rng.randrange(0, 12))) for _ in range(3000)]
    want += [plain.encode(t, add_special_tokens=False).ids for t in texts[len(want):]]
    for cache, group in ((300_000, 1 << 20), (50, 2000)):
        enc = Encoder(public_tokenizer(), cache)
        assert enc.by_piece
        assert [x.tolist() for x in enc.encode(texts, group)] == want
    assert not Encoder(public_tokenizer("byte_bpe_50k.json")).by_piece


def test_pieces_of_one_hash_keep_their_own_ids():
    word = "a"
    while len(word) < 4096:  # the Thue-Morse word and its complement share every polynomial hash modulo 2**64
        word += word.translate({97: "b", 98: "a"})
    plain = Tokenizer.from_file(public_tokenizer())
    enc = Encoder(public_tokenizer())
    for n in (64, 128, 256, 512, 1024, 2048, 4096):
        x = word[:n]
        text = f"so {x} {x.translate({97: 'b', 98: 'a'})} and {x}"
        assert next(enc.encode([text])).tolist() == plain.encode(text, add_special_tokens=False).ids
    # two short pieces made to share a hash, in one batch and across batches
    texts = ["first second first", "second first", "third first second"]
    enc._mark[:] = 1
    enc._power = enc._unpower = np.zeros(64, np.uint64)
    enc._forget()
    for t in ["first", "third", *texts, " ".join(texts)]:
        assert next(enc.encode([t])).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_odd_words_alone_go_through_the_tokenizer(spark):
    rng = random.Random(7)
    docs = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()[:40]]
    bits = ["\u2014", "\u201cquoted\u201d", "e\u0301", "\u0301x", "\u00a0", "\u2003", "漢字", "İ", "ς", "<|endoftext|>", "\u0085",
            "\u1100\u1161", "ﬁ", "\U0001f600"]
    texts = []
    for d in docs:
        words = d.split(" ")
        for _ in range(rng.randrange(1, 6)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bits) + rng.choice(["", "word", " "]))
        texts.append(" ".join(words))
    texts += ["".join(rng.choices([*bits, " ", "\n", "a", "b'll", "9"], k=rng.randrange(0, 14))) for _ in range(1500)]
    plain = Tokenizer.from_file(public_tokenizer())
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for group in (1 << 18, 300, 7):
        assert [x.tolist() for x in Encoder(public_tokenizer()).encode(texts, group)] == want


def test_memory_of_a_long_text_is_that_of_a_slice():
    import tracemalloc
    text = "some common words of a text and more " * 60_000 + "\u2014 " + "and words " * 50_000
    enc = Encoder(public_tokenizer())
    next(enc.encode(["warm up \u2014"]))
    tracemalloc.start()
    ids = next(enc.encode([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) > 500_000 and peak < (40 << 20)


def test_pack_edge_rows_and_ids(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "word " * 9000, "x"), (4, "tie", "x"), (4, "tie", "x")] + [
        (10 + i, "some words here " * (i % 40), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "d long, t string, length string").repartition(5)
    got = pack(df, "d", "t", public_tokenizer(), window=64, with_ids=True).collect()
    enc, docs, seqs = Tokenizer.from_file(public_tokenizer()), {}, {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        docs.setdefault(r.d, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for d, t, _ in rows:
        want = enc.encode(t or "", add_special_tokens=False).ids + [2]
        ids = [i for r in sorted(docs[d], key=lambda r: r.start) for i in r.ids]
        assert ids == want if d != 4 else Counter(ids) == Counter(want * 2)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    lengths = [r.length for r in got]
    assert sorted(64 - sum(r.length for r in s) for s in seqs.values()) == one_by_one(lengths, 64)
    assert sorted(seqs) == list(range(len(seqs)))
    assert pack(df.limit(0), "d", "t", public_tokenizer()).count() == 0


def test_query(spark):
    got = op6_packing(spark, SF_SMALL).collect()
    enc = Tokenizer.from_file(public_tokenizer())
    docs = {r.doc_id: np.array(enc.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
            for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    cover = Counter()
    for r in got:
        ids = docs[r.doc_id]
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        cover[r.doc_id] += r.length
    assert cover == {d: len(i) for d, i in docs.items()}
    assert sorted(4096 - n for n in Counter({s: sum(r.length for r in got if r.sequence_id == s)
                  for s in {r.sequence_id for r in got}}).values()) == one_by_one([r.length for r in got], 4096)
