"""Whole-text token ids from a public tokenizer file, at corpus speed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

# The rules that the word path understands.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

#: Texts of only these characters are their own NFC form, lower-case one to
#: one, and are split alike by any Unicode version.
PLAIN = "\t\n\r" + "".join(
    chr(c) for a, b in ((0x20, 0x7E), (0xA1, 0xA9), (0xAB, 0xAC), (0xAE, 0xB1), (0xB4, 0xB8), (0xBB, 0xBB), (0xBF, 0x12F),
                        (0x131, 0x148), (0x14A, 0x17E)) for c in range(a, b + 1))
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_TOP = 0x17F


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each plain character; others share one place."""
    kind, low = np.full(_TOP + 1, _OTHER, np.uint8), np.arange(_TOP + 1, dtype=np.uint32)
    for c in PLAIN:
        kind[ord(c)] = _SPACE if c.isspace() else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SIGN
        low[ord(c)] = ord(c.lower())
    return kind, low


_KIND, _LOW = _tables()


def _byte_letters() -> list[str]:
    """The visible letter that stands for each byte in byte-level models:
    printable Latin-1 itself, the others from U+0100 on in order."""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    rest = iter(range(256, 512))
    return [chr(c) if c in shown else chr(next(rest)) for c in range(256)]


_BYTES = dict(enumerate(_byte_letters()))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


_WHITE = re.compile("[ \t\n\r]")


class Encoder:
    """Token ids of texts by one ``tokenizers`` file, without special tokens.

    Files that lower-case and split by the rules above are encoded piece by
    piece: pieces are found on character arrays, each distinct piece goes
    through the model once, and texts are put together from the kept ids,
    which gives the ids of the whole text.  Kept pieces are looked up by a
    64-bit hash and then compared letter by letter; about ``keep_pieces`` of
    at most ``LONGEST`` letters are kept, then forgotten.  Of a text only the
    words (between white space, which no piece spans) that hold other than
    plain characters or a special token's string go through the tokenizer as
    they are, so memory beyond the ids is that of ``group_chars`` characters
    or of the longest word.  Texts for other files go through it whole.
    """
    LONGEST = 256

    def __init__(self, path: str, keep_pieces: int = 300_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_piece = (
            (rules.get("normalizer") or {}).get("normalizers") == _NORMAL and not rules.get("post_processor")
            and len(pre) == 2 and pre[0].get("pattern") == {"Regex": _SPLIT} and pre[0].get("invert") is True
            and pre[0].get("behavior") == "Removed" and pre[1].get("type") == "ByteLevel"
            and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
            and rules["model"].get("unk_token") is None)
        special = [t["content"] for t in rules.get("added_tokens", [])]
        if any(_WHITE.search(x) for x in special):
            self.by_piece = False  # such a token spans words
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._odd_ids: dict[str, np.ndarray] = {}
        self.keep_pieces = keep_pieces
        rng = np.random.default_rng(1)
        self._mark = rng.integers(1, 1 << 63, _TOP + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        self._power = self._unpower = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self._seen = np.empty(0, np.uint64)                   # hashes, sorted
        self._first = self._count = np.empty(0, np.int32)     # where in _flat, and how many
        self._flat = np.empty(0, np.uint32)
        self._spelled = np.empty(0, np.int32)                 # where in _letters
        self._letters = np.empty(0, np.uint16)

    def _powers(self, n: int) -> None:
        if len(self._power) < n:
            for name, base in (("_power", _BASE), ("_unpower", _BACK)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def _cut(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased codes, and begin and end of each piece."""
        kind, low = _KIND[codes], _LOW[codes]
        starts = (kind != _SPACE) & ((kind == _DIGIT) | np.concatenate(([True], kind[1:] != kind[:-1])))
        for i in np.flatnonzero((low == 39) & starts).tolist():
            after = low[i + 1:i + 3].tobytes().decode("utf-32-le")
            end = next((e for e in _ENDINGS if after.startswith(e)), None)
            if end:
                starts[i + 1] = False
                if i + 1 + len(end) < len(kind) and kind[i + 1 + len(end)] != _SPACE:
                    starts[i + 1 + len(end)] = True
        bounds = np.flatnonzero(starts | (kind == _SPACE))
        mine = starts[bounds]
        return low, bounds[mine], np.append(bounds[1:], len(codes))[mine]

    def _ids(self, word: str) -> list[int]:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.tokenizer.model.tokenize(spelled)]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = [self._ids(w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        chars = np.fromiter(map(len, words), np.int64, len(words))
        at = np.searchsorted(self._seen, hashes)
        self._seen = np.insert(self._seen, at, hashes)
        self._first = np.insert(self._first, at, len(self._flat) + np.cumsum(sizes) - sizes)
        self._count = np.insert(self._count, at, sizes)
        self._spelled = np.insert(self._spelled, at, len(self._letters) + np.cumsum(chars) - chars)
        self._flat = np.concatenate([self._flat, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))])
        self._letters = np.concatenate([self._letters, np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)])

    def _by_piece(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts of plain characters."""
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        if not len(codes):
            return [np.empty(0, np.uint32)] * len(texts)
        low, begin, end = self._cut(codes)
        limits = np.cumsum([len(t) + 1 for t in texts])
        of_text = np.concatenate(([0], np.searchsorted(begin, limits)))
        long = end - begin
        if long.max(initial=0) > self.LONGEST:
            return self._by_word(low, begin, end, of_text)
        self._powers(len(codes) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(
            self._mark[low] * self._power[:len(low)], dtype=np.uint64)))
        value = (sums[end] - sums[begin]) * self._unpower[begin]
        value ^= long.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        kinds, where, which = np.unique(value, return_index=True, return_inverse=True)
        if len(self._seen) + len(kinds) > self.keep_pieces:
            self._forget()
        at = np.minimum(np.searchsorted(self._seen, kinds), max(0, len(self._seen) - 1))
        new = self._seen[at] != kinds if len(self._seen) else np.ones(len(kinds), bool)
        if new.any():
            text = low.tobytes().decode("utf-32-le")
            self._learn(kinds[new], [text[b:e] for b, e in zip(begin[where[new]].tolist(), end[where[new]].tolist())])
            at = np.searchsorted(self._seen, kinds)
        # pieces cover all but the white space, so their letters lie in a row
        stops = np.cumsum(long)
        kept = np.repeat(self._spelled[at][which] - (stops - long), long) + np.arange(int(long.sum()))
        if not np.array_equal(self._letters[np.minimum(kept, max(0, len(self._letters) - 1))],
                              low[_KIND[codes] != _SPACE]):
            return self._by_word(low, begin, end, of_text)  # two pieces share a hash
        first, sizes = self._first[at][which], self._count[at][which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self._flat[np.repeat(first - (ends - sizes), sizes) + np.arange(total)]
        upto = np.concatenate(([0], ends))[of_text]
        return [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def _by_word(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray, of_text: np.ndarray) -> list[np.ndarray]:
        """The same with nothing kept but the spellings at hand."""
        text, known = low.tobytes().decode("utf-32-le"), {}
        found = []
        for b, e in zip(begin.tolist(), end.tolist()):
            word = text[b:e]
            if word not in known:
                known[word] = np.array(self._ids(word), np.uint32)
            found.append(known[word])
        return [np.concatenate([np.empty(0, np.uint32), *found[a:b]])
                for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist())]

    def _odd(self, word: str) -> np.ndarray:
        if word not in self._odd_ids:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)
            if len(word) > self.LONGEST:
                return ids
            if len(self._odd_ids) >= 100_000:
                self._odd_ids.clear()
            self._odd_ids[word] = ids
        return self._odd_ids[word]

    def _parts(self, text: str, group_chars: int) -> Iterator[list[str]]:
        """The text in slices of about ``group_chars`` cut at white space,
        each as a list of plain stretches and, between them, runs of odd words."""
        at = 0
        while at < len(text):
            to = min(len(text), at + group_chars)
            if to < len(text):
                white = _WHITE.search(text, to)
                to = white.start() if white else len(text)
            part, at = text[at:to], to
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            odd = np.flatnonzero(_KIND[np.minimum(codes, _TOP)] == _OTHER)
            if self._special and (found := [m.start() for m in self._special.finditer(part)]):
                odd = np.union1d(odd, found)
            if not len(odd):
                yield [part]
                continue
            white = np.flatnonzero((codes == 32) | (codes == 9) | (codes == 10) | (codes == 13))
            word = np.unique(np.searchsorted(white, odd))  # odd words, by the number of white ones before
            runs = np.split(word, np.flatnonzero(np.diff(word) != 1) + 1)
            out, last = [], 0
            for a, z in ((int(r[0]), int(r[-1])) for r in runs):
                begin = int(white[a - 1]) + 1 if a else 0
                end = int(white[z]) if z < len(white) else len(part)
                out += [part[last:begin], part[begin:end]]
                last = end
            yield [*out, part[last:]]

    def encode(self, texts: list[str], group_chars: int = 1 << 17) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, in order; about ``group_chars`` of
        text are in work at a time."""
        if not self.by_piece:
            for t in texts:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            return
        group: list[tuple[int, list[str]]] = []   # (number of the text, its stretches and odd runs)
        done: list[np.ndarray] = []               # of the text that the group begins with
        chars, first = 0, 0

        def flush(upto: int) -> Iterator[np.ndarray]:
            """Ids of the group; yields the texts before ``upto``."""
            nonlocal done, group, chars, first
            plain = iter(self._by_piece([x for _, parts in group for x in parts[::2]]) if group else ())
            held: dict[int, list[np.ndarray]] = {first: done}
            for i, parts in group:
                held.setdefault(i, []).extend(self._odd(x) if k % 2 else next(plain) for k, x in enumerate(parts))
            for i in range(first, upto):
                got = held.pop(i, [])
                yield got[0] if len(got) == 1 else np.concatenate([np.empty(0, np.uint32), *got])
            group, chars, first, done = [], 0, upto, held.get(upto, [])
        for i, t in enumerate(texts):
            for parts in self._parts(t, group_chars):
                group.append((i, parts))
                chars += sum(map(len, parts))
                if chars > group_chars:
                    yield from flush(i)
        yield from flush(len(texts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file; a worker process keeps it between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


__all__ = ["Encoder", "encoder"]
