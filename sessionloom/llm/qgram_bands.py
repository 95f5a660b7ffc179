"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared as code points, letters lowered one by one and white space read as blanks, so places stay those of the text.
Each benchmark item is cut into windows of ``WINDOW`` characters, half overlapping; a shorter item is one window. A window
of w characters that occurs with at most k edits shares w - q + 1 - k q q-grams with its occurrence, all within k diagonals. Shared
q-grams are counted in diagonal bands that overlap by half; bands that reach this bound are verified by a banded
alignment of the window. The edit budget is ``EDITS`` of the window, less where the bound would be under one.

The items are a set of queries against all documents, taken in blocks of about ``BLOCK_BYTES`` of text: a block is broadcast, all documents are
read against it, and it is given up before the next one. Items of one id are one item, whatever blocks their texts fall in.

Defined cases: null or empty texts hold nothing; items of fewer than ``Q`` characters are found in nothing; null and repeated ids are carried as they
are (items with equal id are one item, rows of documents are judged one by one); empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize
from .text_bytes import distinct

Q = 8
WINDOW = 96
EDITS = 0.1
BLOCK_BYTES = 4 << 20
HELD = 1 << 20  # characters filtered at once
GAP = np.uint32(0xFFFFFFFF)  # stands between documents
MARKS = 22  # bits of the table that is asked first
BASE = 0x9E3779B97F4A7C15
_fold: list[np.ndarray] = []


def folded(text: str) -> np.ndarray:
    """Code points, lowered where that keeps one character, white space as blanks."""
    if not _fold:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x1F000):
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
            if chr(c).isspace():
                table[c] = 32
        _fold.append(table)
    return _fold[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def qgram_keys(codes: np.ndarray) -> np.ndarray:
    """Keys of the q-grams of eight characters by start."""
    keys, factor = codes.astype(np.uint64), BASE
    for step in (1, 2, 4):
        keys = keys[:-step] * np.uint64(factor) + keys[step:] if len(keys) > step else keys[:0]
        factor = factor * factor % (1 << 64)
    return keys ^ (keys >> np.uint64(29))


class Windows:
    """The windows of some items and an index from q-gram keys to their places."""

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        self.item: list[int] = []
        self.codes: list[np.ndarray] = []
        self.budget: list[int] = []
        for i, (_, text) in enumerate(items):
            codes = folded(text or "")
            if len(codes) < Q:
                continue
            last = max(0, len(codes) - WINDOW)
            for begin in sorted({*range(0, last, WINDOW // 2), last}):
                part = codes[begin : begin + WINDOW]
                self.item.append(i)
                self.codes.append(part)
                self.budget.append(min(int(EDITS * len(part)), (len(part) - Q) // Q))
        keys = [qgram_keys(c) for c in self.codes]
        where = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys]) if keys else np.zeros(0, np.int64)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.place, self.owner = keys[order], where[order], owner[order]
        budget = np.array(self.budget, dtype=np.int64)
        size = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.width, self.needed = np.maximum(2 * budget, 1), size - Q + 1 - budget * Q
        self.marks = np.zeros(1 << MARKS, dtype=bool)
        self.marks[self.keys >> np.uint64(64 - MARKS)] = True

    def bands(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, first diagonal, last diagonal) of the bands that reach the bound."""
        keys = qgram_keys(codes)
        at = np.flatnonzero(self.marks[keys >> np.uint64(64 - MARKS)])
        low, high = (np.searchsorted(self.keys, keys[at], side) for side in ("left", "right"))
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        # All places of the benchmark with the q-gram.
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        window, place = self.owner[entry], self.place[entry]
        diagonal = np.repeat(at, n) - place + WINDOW  # never negative
        width = self.width[window]
        # A band is its window and its cell, packed with a place of the window into one number: as many bits as each needs.
        cells = int(diagonal.max(initial=0) // self.width.min(initial=1) + 2).bit_length() if len(diagonal) else 1
        if cells + WINDOW.bit_length() + len(self.codes).bit_length() > 63:
            raise OverflowError("too many windows for texts of this length; use smaller blocks of items")
        found = []
        for shift in (0, 1):  # a band is two cells; a hit counts for both bands that have its cell
            band = (window << cells) + (diagonal // width + 1 - shift)
            # A q-gram of the window counts once in a band, however often the text repeats it.
            once = distinct(band * WINDOW + place) // WINDOW
            edge = np.flatnonzero(np.concatenate([[True], once[1:] != once[:-1], [True]])) if len(once) else np.zeros(1, np.int64)
            bands, count = once[edge[:-1]], np.diff(edge)
            found.append(bands[count >= self.needed[bands >> cells]])
        bands = distinct(np.concatenate(found))
        owner, first = bands >> cells, (bands & ((1 << cells) - 1)) - 1
        # Bands of a window that touch are verified as one strip.
        new = np.ones(len(bands), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (first[1:] - first[:-1] > 2)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(bands)) - 1 if len(bands) else starts
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            w, size = int(owner[s]), int(self.width[owner[s]])
            yield w, int(first[s]) * size - WINDOW, (int(first[e]) + 2) * size - WINDOW - 1


def best_match(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of the pattern in a strip of text, if within ``most`` edits."""
    steps = np.arange(len(text) + 1, dtype=np.int32)
    rows = [np.zeros(len(text) + 1, dtype=np.int32)]
    for i, code in enumerate(pattern, 1):
        above = rows[-1]
        row = above + 1
        row[1:] = np.minimum(row[1:], above[:-1] + (text != code))
        row[0] = i
        rows.append(np.minimum.accumulate(row - steps) + steps)
    end = j = int(rows[-1].argmin())
    edits, i = int(rows[-1][j]), len(pattern)
    if edits > most:
        return None
    while i > 0:
        if j > 0 and rows[i][j] == rows[i - 1][j - 1] + (text[j - 1] != pattern[i - 1]):
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return edits, j, end


def find(windows: Windows, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every window found."""
    begin = 0
    while begin < len(texts):
        codes, ends, held, i = [], [], 0, begin
        while i < len(texts) and (not codes or held < HELD):
            codes += [folded(texts[i] or ""), np.array([GAP])]
            held += len(codes[-2]) + 1
            ends.append(held)
            i += 1
        row, ends = np.concatenate(codes), np.array(ends)
        for w, first, last in windows.bands(row):
            k, pattern = windows.budget[w], windows.codes[w]
            low, high = max(0, first - k), min(len(row), last + len(pattern) + k + 1)
            # A strip at a border may touch several texts; each is aligned by itself.
            for t in range(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high - 1, "right")) + 1):
                if t == len(ends):
                    continue
                start = int(ends[t - 1]) if t else 0
                a, b = max(low, start), min(high, int(ends[t]) - 1)
                if b - a >= len(pattern) - k and (match := best_match(pattern, row[a:b], k)):
                    yield begin + t, windows.item[w], a - start + match[1], a - start + match[2], match[0]
        begin = i


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each document row and item found in it: ``doc_id``, ``item_id``, ``start``, ``end``, ``n_windows``, ``edits``.

    The span covers all windows of the item that were found, in code points, end exclusive; ``edits`` are those of the closest window.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type, item_type = rows.schema["doc_id"].dataType, benchmark.schema[item_id].dataType
    whole = T.LongType()
    fields = [("doc_id", id_type), ("item_id", item_type), ("spot", whole), ("start", whole), ("end", whole), ("edits", whole)]
    out = T.StructType([T.StructField(n, t) for n, t in fields])
    blocks = item_blocks(benchmark, item_text)
    # A row is known by its place, the same in each pass over the documents: with several passes they are stored first.
    rows = rows.withColumn("spot", F.monotonically_increasing_id())
    rows = rows if blocks == 1 else materialize(rows, "documents")
    parts = []
    for block in range(blocks):
        sent = sent_block(benchmark, item_id, item_text, block, blocks)
        part = rows.mapInArrow(searcher(sent, to_arrow_type(item_type), out.names), out)
        if blocks > 1:
            part = materialize(part, "found")
            sent.unpersist()
        parts.append(part)
    found = reduce(DataFrame.unionByName, parts)
    spans = F.count_distinct("start", "end").cast("long").alias("n_windows")
    merged = found.groupBy("doc_id", "item_id", "spot").agg(F.min("start").alias("start"), F.max("end").alias("end"), spans, F.min("edits").alias("edits"))
    return merged.drop("spot")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item is found. Rows are judged in place, so ids do not matter."""
    place = docs.columns.index(text)

    def dropper(sent):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(sent.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[t for t, *_ in find(windows, batch.column(place).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        return run

    blocks = item_blocks(benchmark, item_text)
    for block in range(blocks):
        sent = sent_block(benchmark, item_id, item_text, block, blocks)
        docs = docs.mapInArrow(dropper(sent), docs.schema)
        if blocks > 1:
            docs = materialize(docs, "clean")
            sent.unpersist()
    return docs


def item_blocks(benchmark: DataFrame, item_text: str) -> int:
    """Blocks that the items make, each of about ``BLOCK_BYTES`` of text."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(item_text).cast("string"))), F.lit(0)).alias("n")).first()["n"]
    return 1 + size // BLOCK_BYTES


def sent_block(benchmark: DataFrame, item_id: str, item_text: str, block: int, blocks: int):
    """A block of the items as a broadcast list of (id, text); the driver holds one block at a time."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))
    own = items.filter(F.pmod(F.coalesce(F.xxhash64("text"), F.lit(0)), F.lit(blocks)) == block).orderBy("item", "text")
    return benchmark.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in own.toLocalIterator()])


def searcher(sent, item_kind: pa.DataType, names: list[str]):
    """Windows found in rows of ``doc_id``, ``text``, ``spot``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        windows = Windows(queries)
        for batch in batches:
            hits = list(find(windows, batch.column(1).to_pylist()))
            rows = pa.array([t for t, *_ in hits], pa.int64())
            items = pa.array([queries[item][0] for _, item, *_ in hits], item_kind)
            spans = [pa.array([hit[i] for hit in hits], pa.int64()) for i in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), items, batch.column(2).take(rows), *spans], names)

    return run
