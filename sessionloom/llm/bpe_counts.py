"""Token counts by byte-pair merging, without the tokens.

Each word starts as a linked list of symbols. A heap holds the adjacent pairs that have a merge, by
rank, then place; the lowest is popped, checked to be still there, merged, and its new
neighbours pushed. A word has as many tokens as initial symbols less merges made; no identifier
is produced. Counts of words are kept between documents in a table of bounded size.

Reads the public JSON layout of a BPE vocabulary whose words never hold white space (NFC, white-space, lower-case
normalizers; a split that keeps only matches; byte-level symbols; a word-end suffix). Strings of added
tokens inside a text count as one token each.

Null or empty text counts 0. Rows are judged alone, so nulls in other columns, ties, repeated rows,
row order and empty tables change nothing. Texts are walked in slices cut at white space.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_bytes import slices

CACHED_WORDS = 300_000
CACHED_LENGTH = 64
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # Unicode White_Space


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class PairMerger:
    """Merges of one vocabulary; counts tokens of words and texts."""

    def __init__(self, spec: dict) -> None:
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        known = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and split["behavior"] == "Removed"
        if model["type"] != "BPE" or not known or not split["invert"] or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("the vocabulary does not drop white space between words")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            joined = left.removesuffix(suffix) if suffix and right == suffix else left
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[joined + right])
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + suffix) for s in symbols]
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", WHITE))
        special = sorted((t["content"] for t in spec["added_tokens"] or ()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    @classmethod
    def read(cls, path: str) -> PairMerger:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def pieces(self, text: str) -> Iterator[list[int]]:
        """Symbol lists of the words of a text without added tokens."""
        # Letters are lowered one by one, so a capital sigma is never a final one.
        plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        for word in self.words.findall(plain):
            data = word.encode()
            symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
            yield [s for s in symbols if s is not None]

    def merged(self, symbols: list[int]) -> int:
        """Tokens that remain of the symbols of a word."""
        n = left = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(pairs[p][0], i) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            merge = pairs.get((symbols[i], symbols[j]))
            if merge is None or merge[0] != rank:
                continue  # the pair that was pushed is gone
            symbols[i], symbols[j] = merge[1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((symbols[i], symbols[k])):
                    heapq.heappush(heap, (found[0], i))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbols[h], symbols[i]))):
                heapq.heappush(heap, (found[0], h))
        return left

    def plain_tokens(self, text: str) -> int:
        return sum(map(self.merged, self.pieces(text)))

    def word_tokens(self, word: str) -> int:
        """Tokens of a run of characters without ASCII white space."""
        if self.special is None:
            return self.plain_tokens(word)
        found = len(self.special.findall(word))
        return found + sum(map(self.plain_tokens, self.special.split(word) if found else [word]))


class WordCounts(dict):
    """Tokens by word, counted when first asked for; emptied when it reaches its size."""

    def __init__(self, merger: PairMerger) -> None:
        self.merger = merger

    def __missing__(self, word: bytes) -> int:
        count = self.merger.word_tokens(word.decode("utf-8", "replace"))
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = count
        return count

    def tokens(self, text: bytes) -> int:
        return sum(sum(map(self.__getitem__, piece.split())) for piece in slices(text))


_COUNTS: dict[str, WordCounts] = {}


def counts_of(path: str) -> WordCounts:
    """The table of this process for a vocabulary; later tasks of the worker go on with it."""
    if path not in _COUNTS:
        _COUNTS[path] = WordCounts(PairMerger.read(path))
    return _COUNTS[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row.

    ``vocabulary`` is a path that every executor can read; added begin and end tokens are not counted.
    """
    id_type = docs.select(doc_id).schema[0].dataType
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            sizes = [len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts]
            tokens = [counts.tokens(t.as_py()) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    raw = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return raw.mapInArrow(run, out).withColumn("over_limit", F.col("n_tokens") > limit)
