"""Byte-level BPE pre-tokens of many texts at once, and ids from a memo of distinct pre-tokens.

The pattern of public_tokenizers (contractions, an optional space before
letters, digits or other marks, runs of white space) becomes rules on classes
of characters, evaluated over whole batches with numpy. Merges never cross
pre-tokens, so each distinct one is encoded once and its ids are copied; the
memo is found by hash and its characters are compared before ids are copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import regex

from .ragged import chunks, slice_hashes, take_runs

OTHER, LETTER, NUMBER, SPACE = range(4)
CHUNK = 500_000
MEMO = 1_500_000
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _CLASSES:
        points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
        text = "".join(map(chr, points.tolist()))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[points[m.start() : m.end()]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def points_of(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")


def starts_of(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes where pre-tokens begin in the joined texts of the given lengths."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    head = np.zeros(n + 1, bool)  # a text begins; beyond the end counts as one
    head[np.cumsum(lengths) - lengths] = True
    head[n] = True
    run = np.ones(n + 1, bool)
    run[1:n] = kind[1:] != kind[:-1]
    run |= head
    start = run[:n].copy()
    # The last white space before other characters of the text stands alone,
    # or with them if it is a plain space.
    last = np.flatnonzero((kind == SPACE) & run[1:] & ~head[1:])
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    # A lone apostrophe that no space precedes takes s, t, m, d, re, ve or ll.
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[~head[quote + 1] & run[quote + 1]]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        a = points[quote + 1]
        b = np.where(run[quote + 2], 0, points[np.minimum(quote + 2, n - 1)])
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for pair in ("re", "ve", "ll"):
            two |= (a == ord(pair[0])) & (b == ord(pair[1]))
        hit = one | two
        start[quote[hit] + 1] = False
        rest = quote[hit] + 1 + np.where(one[hit], 1, 2)
        rest = rest[~run[rest]]
        start[rest] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts. ``encode_all`` gives the ids of each of a list of pre-tokens; each of
    ``whole`` is a pre-token wherever it stands, and texts are cut there first."""

    def __init__(self, encode_all: Callable[[list[str]], list], memo: int = MEMO, whole: Iterable[str] = ()):
        self.encode_all, self.memo = encode_all, memo
        self.whole = sorted(whole, key=len, reverse=True)
        self.mark = regex.compile("|".join(map(regex.escape, self.whole)))
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.first = np.zeros(1 << 16, np.int64)  # of a slot's ids in pool
        self.size = np.zeros(1 << 16, np.int64)
        self.at = np.zeros(1 << 16, np.int64)  # of a slot's characters in spelling
        self.long = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.spelling = np.zeros(1 << 19, np.uint32)
        self.slots_used = self.filled = self.spelled = 0
        self.others: dict[str, int] = {}  # slots of pre-tokens whose hash another one has

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.slot[at], -1)

    def _store(self, tokens: list[str]) -> np.ndarray:
        """New slots for pre-tokens."""
        got = self.encode_all(tokens)
        size, long = (np.fromiter(map(len, x), np.int64, len(x)) for x in (got, tokens))
        total, letters, old = int(size.sum()), int(long.sum()), self.slots_used
        new = old + len(got)
        while new > len(self.first):
            self.first, self.size, self.at, self.long = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.size, self.at, self.long))
        while self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.spelled + letters > len(self.spelling):
            self.spelling = np.concatenate([self.spelling, np.zeros_like(self.spelling)])
        self.pool[self.filled : self.filled + total] = np.fromiter((i for x in got for i in x), np.uint32, total)
        self.spelling[self.spelled : self.spelled + letters] = points_of(tokens)
        self.first[old:new], self.size[old:new] = self.filled + np.cumsum(size) - size, size
        self.at[old:new], self.long[old:new] = self.spelled + np.cumsum(long) - long, long
        self.slots_used, self.filled, self.spelled = new, self.filled + total, self.spelled + letters
        return np.arange(old, new)

    def _add(self, keys: np.ndarray, tokens: list[str]) -> None:
        slots = self._store(tokens)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.slot = np.insert(self.slot, at, slots[order])

    def _compared(self, slots: np.ndarray, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the pre-tokens that tile points are spelt otherwise than their slots."""
        size = end - start
        wrong = self.long[slots] != size
        at = np.where(wrong, 0, self.at[slots])
        if wrong.any():
            size = np.where(wrong, 0, size)
            points = take_runs(points, start, size)
        differs = np.flatnonzero(take_runs(self.spelling, at, size) != points)
        if len(differs):
            wrong[np.searchsorted(np.cumsum(size), differs, "right")] = True
        return np.flatnonzero(wrong)

    def starts(self, points: np.ndarray, lengths: np.ndarray, texts: list[str]) -> np.ndarray:
        """Indexes where pre-tokens begin, with each of ``whole`` as one."""
        begin, end = [], []
        for at, text in zip((np.cumsum(lengths) - lengths).tolist(), texts, strict=True):
            if any(w in text for w in self.whole):
                for m in self.mark.finditer(text):
                    begin.append(at + m.start())
                    end.append(at + m.end())
        if not begin:
            return starts_of(points, lengths)
        edges = np.unique(np.concatenate([[0], np.cumsum(lengths), begin, end]))
        start = starts_of(points, np.diff(edges))
        last = np.searchsorted(begin, start) - 1  # the last that begins before
        return start[(last < 0) | (start >= np.array(end)[last])]

    def slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The memo slot of every pre-token, and the number of pre-tokens of each text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = points_of(texts)
        start = self.starts(points, lengths, texts)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        end = np.append(start[1:], len(points))
        codes, keys = pd.factorize(slice_hashes(points.view(np.uint8), 4 * start, 4 * end))
        if len(self.keys) + len(keys) > self.memo:
            self._reset()
        raw = points.tobytes()

        def spelt(i: int) -> str:
            return raw[4 * start[i] : 4 * end[i]].decode("utf-32-le")

        found = self._find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            where = np.empty(len(keys), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            self._add(keys[new], [spelt(i) for i in where[new]])
            found = self._find(keys)
        slots = found[codes]
        for i in self._compared(slots, points, start, end).tolist():
            token = spelt(i)
            if token not in self.others:
                self.others[token] = int(self._store([token])[0])
            slots[i] = self.others[token]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(np.searchsorted(start, edges))
        return slots, counts

    def encode(self, texts: list[str]):
        """Yield (ids, first): the ids of some texts joined, and where each text's ids begin and end."""
        for a, b in chunks(texts, CHUNK):
            slots, counts = self.slots(texts[a:b])
            size = self.size[slots]
            ends = np.concatenate([[0], np.cumsum(size)])
            edges = ends[np.concatenate([[0], np.cumsum(counts)])]
            yield take_runs(self.pool, self.first[slots], size), edges


def byte_letters() -> str:
    """The printable character that byte-level BPE files write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


def library_encoder(path: str, added: bool = False) -> Encoder:
    """An Encoder by the BPE model of the tokenizers library, for byte-level files.

    added: the file's added tokens are matched inside texts, as the library's
    encode does by default; without it they are spelt like any other text.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    letters = dict(enumerate(byte_letters()))
    ids = {}
    for i, t in tokenizer.get_added_tokens_decoder().items() if added else ():
        if t.lstrip or t.rstrip or t.single_word:
            raise ValueError(f"the added token {t.content!r} takes its surroundings into account")
        ids[t.content] = [i]

    def encode_all(tokens: list[str]) -> list:
        model = tokenizer.model
        return [ids.get(t) or [x.id for x in model.tokenize(t.encode().decode("latin-1").translate(letters))] for t in tokens]

    return Encoder(encode_all, whole=ids)
