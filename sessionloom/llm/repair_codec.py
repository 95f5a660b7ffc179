"""Token ids as Re-Pair grammars: shards of documents in order of id, written, read back, open to random access.

Documents are range-partitioned and sorted by id. Each task tokenises its documents with the vocabulary's library and cuts them into shards of about
``SHARD_IDS`` ids. Within a shard frequent pairs of ids are replaced by nonterminals, round after round, until no pair occurs
``LEAST_COUNT`` times, or a round saves under ``LEAST_GAIN`` of the symbols. A round replaces all pairs that occur at least a ``SHARE``-th as often as
the most frequent one, where strict Re-Pair replaces that one only and counts again; on prose of the test tables this takes a tenth of the
rounds and gives symbols and rules of about 0.6 of the ids, within two in a hundred of a quarter in place of a sixteenth. Of overlapping places the left one is taken. The record of a shard holds its rules, the expansion length of each rule, the final sequence, and where its documents end.
Any range of ids is decoded from the symbols that cover it, found by the running sum of expansion lengths.

The format is one Parquet row per shard: ``part``, ``number`` (together in document order), ``doc_ids``, ``ends`` (ids up to the end of each
document), ``base`` (first nonterminal), ``n_ids`` and the binary ``rules``, ``spans``, ``symbols`` (little-endian, 32 bits; symbols in as few bytes as they need).

Ids of words come from the library itself, once per distinct word and worker: the vocabulary must drop white space, so that a word's ids do not depend on its neighbours.

Defined cases: null and empty texts are the end id alone. Null ids come first, repeated ids by text. Rows that repeat whole are encoded as often as they
occur. An empty table writes no shard and reads as no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.lookup import lookup_join
from ..session import fresh_path
from .text_bytes import distinct
from .word_table import table_of

SHARD_IDS = 1 << 19
LEAST_COUNT = 8
BIN_BITS, BIN_FACTOR = 17, np.uint64(0x9E3779B97F4A7C15)
SHARE = 16  # of the most frequent pair's count that a pair needs to be replaced in the same round
LEAST_GAIN = 1 / 512  # of the symbols that a round has to save for another one to follow


@dataclass
class Grammar:
    """Rules (left, right), the ids each expands to, and the sequence over ids and nonterminals ``base``, ``base + 1``, .."""

    base: int
    rules: np.ndarray
    spans: np.ndarray
    symbols: np.ndarray

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of some symbols."""
        symbols = symbols.astype(np.int64)
        while len(nonterminal := np.flatnonzero(symbols >= self.base)):
            wide = np.ones(len(symbols), dtype=np.int64)
            wide[nonterminal] = 2
            out = np.repeat(symbols, wide)
            at = np.cumsum(wide)[nonterminal] - 2
            pairs = self.rules[symbols[nonterminal] - self.base]
            out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
            symbols = out
        return symbols.astype("<u4")

    def whole(self) -> np.ndarray:
        """Ids of the whole sequence, each rule expanded once; step by step where that takes more room than the ids."""
        n = int(self.ends()[-1]) if len(self.symbols) else 0
        if self.base + int(self.spans.sum()) > n:
            return self.expanded(self.symbols)
        size = np.concatenate([np.ones(self.base, dtype=np.int64), self.spans])
        count = size[self.symbols]
        pool = np.concatenate([np.arange(self.base, dtype="<u4"), self.expanded(np.arange(self.base, self.base + len(self.rules)))])
        offset = (np.cumsum(size) - size)[self.symbols] - (self.ends() - count)
        return pool[np.repeat(offset, count) + np.arange(n)]

    def between(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` .. ``end`` - 1 from the symbols that cover them."""
        if begin >= end:
            return np.zeros(0, dtype="<u4")
        ends = self.ends()
        first, last = np.searchsorted(ends, [begin, end - 1], side="right")
        start = int(ends[first - 1]) if first else 0
        return self.expanded(self.symbols[first : last + 1])[begin - start : end - start]

    def ends(self) -> np.ndarray:
        """Ids up to the end of each symbol."""
        if not hasattr(self, "_ends"):
            size = np.ones(len(self.symbols), dtype=np.int64)
            high = self.symbols >= self.base
            size[high] = self.spans[self.symbols[high].astype(np.int64) - self.base]
            self._ends = np.cumsum(size)
        return self._ends


def frequent_pairs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pairs to replace in this round, sorted; the places where they occur; and which pair is at each place.

    Pairs are counted by hash first. That bounds every count from above, so only places whose bound reaches the least count are sorted.
    """
    keys = (symbols[:-1] << np.int64(32)) | symbols[1:]
    bins = ((keys.view(np.uint64) * BIN_FACTOR) >> np.uint64(64 - BIN_BITS)).view(np.int64)
    bound = np.bincount(bins)[bins]
    most = int(bound.max())
    while True:
        least = max(LEAST_COUNT, most // SHARE)
        at = np.flatnonzero(bound >= least)
        pairs, which, count = np.unique(keys[at], return_inverse=True, return_counts=True)
        top = int(count.max(initial=0))
        if max(LEAST_COUNT, top // SHARE) == least:
            break
        most = top if top >= least else least - 1
    chosen = count >= least
    taken = chosen[which]
    return pairs[chosen], at[taken], (np.cumsum(chosen) - 1)[which[taken]]


def compressed(ids: np.ndarray) -> Grammar:
    """Re-Pair grammar of a sequence of ids."""
    symbols = ids.astype(np.int64)
    base = int(symbols.max()) + 1 if len(symbols) else 1
    rules, spans, size = [], [], 0
    while len(symbols) > 1:
        chosen, at, which = frequent_pairs(symbols)
        if not len(chosen):
            break
        # Of places that follow each other, the first, third, .. are taken, so no two overlap.
        new = np.concatenate([[True], np.diff(at) > 1])
        start = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        taken = (at - start) % 2 == 0
        at, which = at[taken], which[taken]
        used = distinct(which)
        pairs = np.stack([chosen[used] >> 32, chosen[used] & 0xFFFFFFFF], axis=1)
        known = np.concatenate(spans) if spans else np.zeros(0, dtype=np.int64)
        width = np.where(pairs < base, 1, known[np.maximum(pairs - base, 0)] if len(known) else 1)
        symbols[at] = base + size + np.searchsorted(used, which)
        before = len(symbols)
        keep = np.ones(before, dtype=bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        rules.append(pairs)
        spans.append(width.sum(axis=1))
        size += len(used)
        if len(at) < LEAST_GAIN * before:
            break
    none = np.zeros((0, 2), dtype=np.int64)
    return Grammar(base, np.concatenate(rules) if rules else none, np.concatenate(spans) if spans else none[:, 0], symbols)


def narrow(values: np.ndarray) -> bytes:
    """Numbers in two, three or four bytes, after a byte that says so."""
    width = 2 if not len(values) or values.max() < 1 << 16 else 3 if values.max() < 1 << 24 else 4
    return bytes([width]) + values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def widened(data: bytes) -> np.ndarray:
    width = data[0]
    rows = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(rows), 4), dtype=np.uint8)
    out[:, :width] = rows
    return out.reshape(-1).view("<u4").astype(np.int64)


def shard_schema(id_type: T.DataType) -> T.StructType:
    names = [("part", T.LongType()), ("number", T.LongType()), ("doc_ids", T.ArrayType(id_type)), ("ends", T.ArrayType(T.LongType())), ("base", T.LongType()), ("n_ids", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in [*names, *[(n, T.BinaryType()) for n in ("rules", "spans", "symbols")]]])


def encode(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Write all documents, each with ``end_id`` after it, as shards under ``path``."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    id_kind = to_arrow_type(rows.schema["id"].dataType)
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, number = table_of(vocabulary), TaskContext.get().partitionId(), 0
        ids, coded, held = [], [], 0

        def shard() -> pa.RecordBatch:
            whole = np.concatenate(coded)
            g = compressed(whole)
            ends = np.cumsum([len(c) for c in coded[0::2]]) + np.arange(1, len(ids) + 1)
            values = [part, number, ids, ends.tolist(), g.base, len(whole), g.rules.astype("<u4").tobytes(), g.spans.astype("<u4").tobytes(), narrow(g.symbols)]
            kinds = [pa.int64(), pa.int64(), pa.list_(id_kind), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            texts = (text.as_py() for text in batch.column(1))
            for key, own in zip(batch.column(0).to_pylist(), known.ids(texts), strict=True):
                ids.append(key)
                coded += [own, end]
                held += len(coded[-2]) + 1
                if held >= shard_ids:
                    yield shard()
                    ids, coded, held, number = [], [], 0, number + 1
        if ids:
            yield shard()

    schema = shard_schema(rows.schema["id"].dataType)
    names = schema.names
    rows.mapInArrow(run, schema).write.parquet(path)


def decode(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards under ``path``: ``doc_id``, ``start`` (ids of all before it), ``ids`` (binary, little-endian 32 bits)."""
    shards = spark.read.parquet(path)
    by_part = shards.groupBy("part").agg(F.sum("n_ids").alias("_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("part", "number", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_local"))
    offsets = lookup_join(offsets, bases, ["part"], "inner").select("part", "number", (F.col("_base") + F.col("_local")).alias("first"))
    id_type = shards.schema["doc_ids"].dataType.elementType
    id_kind = to_arrow_type(id_type)
    names = ["doc_id", "start", "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], dtype="<u4").astype(np.int64).reshape(-1, 2)
                g = Grammar(row["base"], rules, np.frombuffer(row["spans"], dtype="<u4").astype(np.int64), widened(row["symbols"]))
                starts = [0, *row["ends"][:-1]]
                # The whole shard is read, so it is expanded once; one document alone comes from ``between``.
                whole = g.whole()
                ids = [whole[b:e].tobytes() for b, e in zip(starts, row["ends"], strict=True)]
                places = pa.array([row["first"] + s for s in starts], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], id_kind), places, pa.array(ids, pa.binary())], names)

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    placed = lookup_join(shards, offsets, ["part", "number"], "inner")
    return placed.select("doc_ids", "ends", "base", "rules", "spans", "symbols", "first").mapInArrow(run, schema)


def encoded_digests(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the documents, read the files back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of each."""
    path = fresh_path(docs.sparkSession, "ids")
    encode(docs, vocabulary, path, end_id)
    found = decode(docs.sparkSession, path)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
