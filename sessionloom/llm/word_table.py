"""Ids of words by a tokenizers library, asked once for each word, and looked up for all words of many texts at once.

A word is a maximal run of bytes other than ASCII white space. Words of up to 16 bytes are known by these bytes and their number: two 64-bit
numbers, hashed to one that a sorted array holds. A word is taken as known only if both numbers and its length agree, so the hash is
never trusted. Longer words, and those whose hash another word has, are looked up one by one. The table is emptied when it holds ``CACHED_WORDS`` words or
``CACHED_IDS`` ids; that changes no result.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np

from .text_bytes import GOLD, IS_SPACE, SLICE, U, mix, slices

CACHED_WORDS, CACHED_IDS = 1_500_000, 12_000_000
RECENT = 1 << 16  # new words that are kept apart before they join the large table
SHORT = 16
BATCH, GROUP = 8192, 256  # words the library is asked for at once, and parted in one text
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
FIELDS = ("keys", "low", "high", "size", "offset", "count")
KINDS = (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64)


class Level:
    """Some words sorted by key, with the place of their ids."""

    def __init__(self, *columns: np.ndarray) -> None:
        for name, column in zip(FIELDS, columns or [np.zeros(0, dtype=k) for k in KINDS], strict=True):
            setattr(self, name, column)

    def find(self, keys: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is known, and its row."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (self.keys[at] == keys) & (self.low[at] == low) & (self.high[at] == high) & (self.size[at] == size), at

    def with_rows(self, other: Level) -> Level:
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        return Level(*[np.concatenate([getattr(self, n), getattr(other, n)])[order] for n in FIELDS])


class WordTable:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # A special token that stands alone anywhere parts words, so that the library is asked for many at a time.
        plain = [(i, t) for i, t in self.library.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.parting = (plain[0][0], plain[0][1].content) if plain else None
        self.clear()

    def clear(self) -> None:
        self.large, self.recent = Level(), Level()
        self.single: dict[bytes, tuple[int, int]] = {}
        self.pool, self.held = np.zeros(1 << 16, dtype="<u4"), 0

    def _asked(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of some words, and their number for each word."""
        codes = [c.ids for c in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for c in codes for i in c], dtype="<u4"), [len(c) for c in codes]

    def _asked_together(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The same, the words parted by a special token."""
        if self.parting is None:
            return self._asked(texts)
        mark, content = self.parting
        groups = [content.join(texts[b : b + GROUP]) for b in range(0, len(texts), GROUP)]
        codes = self.library.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.array([i for c in codes for i in (*c.ids, mark)], dtype="<u4")
        at = np.flatnonzero(ids == mark)
        if len(at) != len(texts):  # a word holds the token itself
            return self._asked(texts)
        return ids[ids != mark], (np.diff(at, prepend=-1) - 1).tolist()

    def _store(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ask the library for words; where their ids lie in the pool."""
        counts, parts = [], [np.zeros(0, dtype="<u4")]
        for begin in range(0, len(words), BATCH):
            ids, numbers = self._asked_together([w.decode("utf-8", "replace") for w in words[begin : begin + BATCH]])
            parts.append(ids)
            counts += numbers
        new = np.concatenate(parts)
        if self.held + len(new) > len(self.pool):
            grown = np.zeros(2 * (self.held + len(new)), dtype="<u4")
            grown[: self.held] = self.pool[: self.held]
            self.pool = grown
        self.pool[self.held : self.held + len(new)] = new
        count = np.array(counts, dtype=np.int64)
        offset = self.held + np.cumsum(count) - count
        self.held += len(new)
        return offset, count

    def _one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        new = list({w for w in words if w not in self.single})
        self.single.update(zip(new, zip(*self._store(new), strict=True), strict=True))
        both = np.array([self.single[w] for w in words], dtype=np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of each word of ``data``, and offset and number of its ids in the pool."""
        raw = np.frombuffer(data + bytes(SHORT), dtype=np.uint8)
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~IS_SPACE[raw[: len(data)]]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[0::2], edges[1::2]
        offset, count = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        if len(self.large.keys) + len(self.recent.keys) + len(self.single) > CACHED_WORDS or self.held > CACHED_IDS:
            self.clear()
        size = end - start
        short = np.flatnonzero(size <= SHORT)
        eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        at, n = start[short], size[short]
        low = eight[at] & MASKS[np.minimum(n, 8)]
        high = eight[np.minimum(at + 8, len(raw) - 8)] & MASKS[np.maximum(n - 8, 0)]
        keys = mix(low * GOLD + mix(high + n.astype(np.uint64)) + U(1))
        # In order of key the tables are read from one end to the other.
        order = np.argsort(keys)
        short, at, n, low, high, keys = (x[order] for x in (short, at, n, low, high, keys))

        def look(level: Level, rows: np.ndarray) -> np.ndarray:
            known, row = level.find(keys[rows], low[rows], high[rows], n[rows])
            hit = short[rows[known]]
            offset[hit], count[hit] = level.offset[row[known]], level.count[row[known]]
            return rows[~known]

        rest = look(self.recent, look(self.large, np.arange(len(short))))
        if len(rest):
            _, first = np.unique(keys[rest], return_index=True)
            new = rest[first]
            words = [data[b : b + k] for b, k in zip(at[new].tolist(), n[new].tolist(), strict=True)]
            self.recent = self.recent.with_rows(Level(keys[new], low[new], high[new], n[new], *self._store(words)))
            rest = look(self.recent, rest)
            if len(self.recent.keys) > RECENT:
                self.large, self.recent = self.large.with_rows(self.recent), Level()
        odd = np.concatenate([np.flatnonzero(size > SHORT), short[rest]])
        if len(odd):
            offset[odd], count[odd] = self._one_by_one([data[b:e] for b, e in zip(start[odd].tolist(), end[odd].tolist(), strict=True)])
        return start, offset, count

    def _ids(self, data: bytes, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of the pieces of ``data`` that end at ``ends``."""
        start, offset, count = self._words(data)
        total = np.cumsum(count)
        ids = self.pool[np.repeat(offset - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)]
        until = np.searchsorted(start, ends)
        cuts = np.concatenate([[0], total])[until]
        return np.split(ids, cuts[:-1])

    def ids(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """Ids of every text, in order."""
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            if held:
                yield from self._ids(b"\n".join(held), np.cumsum([len(t) + 1 for t in held]))
            held.clear()

        for text in texts:
            text = text or b""
            if size + len(text) > SLICE:
                yield from flush()
                size = 0
            if len(text) > SLICE:
                parts = [self._ids(piece, np.array([len(piece)]))[0] for piece in slices(text)]
                yield np.concatenate(parts)
                continue
            held.append(text)
            size += len(text) + 1
        yield from flush()


_TABLES: dict[str, WordTable] = {}


def table_of(path: str) -> WordTable:
    """The table of a vocabulary file in this worker."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]
