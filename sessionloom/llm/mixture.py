"""Mixing sources to target weights.

The words of a source, its documents in order of id, are packed into blocks of ``block`` words. The mix is a row of slots, one block each,
cut into shards. Every shard draws how many of its slots each source gets from a multinomial over the targets. Where the draws of all
shards give a source more slots than its target holds, its last ones go to the sources that were given too few. The j-th slot of a
source, over all shards, takes the block ``permutation(j mod n)`` of its n blocks, with another keyed permutation for each pass, and no slot
past two passes: no document gives more than twice its words. Blocks and slots are joined by (source, block).

Everything follows from the rows and the seed, so reruns agree. Places come from running totals in two steps (a range
partition, then one sum per partition and source), so a source with a third of all rows is spread over many tasks.
Two rows per source, of its size and of its drawn slots, go through the driver.

Defined cases: null or empty texts have no word, take no room and are never taken; a null source is a source of its own, last in order; null ids come
first. Rows that repeat whole are rows of their own; rows equal in id, source and text that differ elsewhere are mixed with the other
columns of one of them, the same one in every run. An empty table gives an empty result. Other columns are only carried by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import lookup_join
from ..session import materialize
from .columns import SPACE, let, spaced_words, whole, words
from .text_bytes import mix

BLOCK, SLOTS, SEED = 64, 4096, 11
WEIGHTS = (3, 1, 2)
SHARE, PASSES = 1.5, 2
SLOT_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


@dataclass(frozen=True)
class Source:
    key: str
    size: int
    target: float
    blocks: int


def running_totals(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the same group before this one in ``order``; stored.

    ``spot`` is added too, a number of its own for every row. No task holds a group: rows are range-partitioned by group and order.
    """
    placed = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    stored = materialize(placed.withColumn("spot", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("spot", SLOT_BITS)
    stored = stored.withColumn("_part", part)
    inside = Window.partitionBy(group, "_part").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    sums = sums.select(group, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    local = stored.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = lookup_join(local, sums, [group, "_part"], "inner")
    return joined.withColumn(name, (F.col("_base") + F.col("_local")).cast("long")).drop("_base", "_local", "_part")


def source_key(source: str) -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t"))


def water_filled(sizes: list[int], weights: list[int], share: float = SHARE, most: float = PASSES) -> list[float]:
    """Targets by weight that sum to ``share`` of all sizes, none above ``most`` times its size."""
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        for i in full or open_:
            targets[i] = float(most * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(most * sizes[i] for i in full)
        open_ -= full
    return targets


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n-1 (four Feistel rounds, walked back into range)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1342543DE82EF95) % 2**64)
            left, right = right, left ^ (mix(right + salt) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= n
    return out.astype(np.int64)


def slot_targets(sources: list[Source], block: int) -> np.ndarray:
    """Slots of each source over all shards: its target in blocks, rounded so that they sum to the rounded sum."""
    wanted = np.array([s.target / block for s in sources])
    slots = np.floor(wanted).astype(np.int64)
    missing = round(float(wanted.sum())) - int(slots.sum())
    slots[np.argsort(slots - wanted, kind="stable")[:missing]] += 1
    return slots


def shard_counts(spark, targets: np.ndarray, slots: int, seed: int) -> DataFrame:
    """``shard``, ``number`` (of the source), ``n``: slots of each source in each shard, drawn from a multinomial."""
    all_slots = int(targets.sum())
    shares = targets / max(all_slots, 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column(0).to_pylist()
            drawn = [np.random.default_rng([seed, s]).multinomial(min(slots, all_slots - s * slots), shares) for s in shards]
            rows = [(s, i, int(n)) for s, counts in zip(shards, drawn, strict=True) for i, n in enumerate(counts) if n]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "number", "n"])

    return spark.range(-(-all_slots // slots)).mapInArrow(run, "shard long, number long, n long")


@dataclass(frozen=True)
class Settled:
    """Which source and which of its slots a drawn slot ends up as: those past a target fill, in order, what others lack."""

    targets: np.ndarray
    drawn: np.ndarray

    def slots(self, number: int, first: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
        target, own = int(self.targets[number]), np.arange(first, first + n)
        if len(kept := own[own < target]):
            yield number, kept
        if len(over := own[own >= target]):
            excess = np.maximum(self.drawn - self.targets, 0)
            ends = np.cumsum(np.maximum(self.targets - self.drawn, 0))
            rank = over - target + int(excess[:number].sum())
            taker = np.searchsorted(ends, rank, side="right")
            for k in np.unique(taker).tolist():
                yield k, rank[taker == k] - (int(ends[k - 1]) if k else 0) + int(self.drawn[k])


def draws(spark, sources: list[Source], slots: int, block: int, seed: int) -> DataFrame:
    """``shard``, ``slot``, ``src``, ``block``, ``turn`` (which pass) of every slot that takes a block."""
    targets = slot_targets(sources, block)
    counts = running_totals(shard_counts(spark, targets, slots, seed), "number", ["shard"], "n", "first")
    sums = dict(counts.groupBy("number").agg(F.sum("n")).collect())
    settled = Settled(targets, np.array([sums.get(i, 0) for i in range(len(sources))], dtype=np.int64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, n, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for taker, j in settled.slots(number, first, n):
                    source = sources[taker]
                    turn, place = j // source.blocks, np.zeros(len(j), dtype=np.int64)
                    for t in np.unique(turn).tolist():
                        own = turn == t
                        key = int(mix(np.array([seed * 1000003 + taker * PASSES + t], dtype=np.uint64))[0])
                        place[own] = permuted(j[own] % source.blocks, source.blocks, key)
                    columns = [pa.array([shard] * len(j), pa.int64()), pa.array(j), pa.array([source.key] * len(j)), pa.array(place), pa.array(turn)]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "slot", "src", "block", "turn"])

    # The counts are few, the draws are not: shards keep their own tasks.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return counts.select("shard", "number", "n", "first").repartition(partitions, "shard").mapInArrow(run, "shard long, slot long, src string, block long, turn long")


def planned(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, slots: int = SLOTS, seed: int = SEED
) -> tuple[DataFrame, DataFrame, list[Source]]:
    """The documents with their places in their sources, their pieces in drawn blocks, and the sources.

    Documents: ``id``, ``src``, ``digest`` (of the text), ``size``, ``spot``, ``start``. Pieces: ``spot``, ``shard``, ``slot``, ``turn``, ``block``,
    ``skip`` (words of the document before the piece), ``n``.
    """
    body = whole(text)
    sized = docs.select(
        F.col(doc_id).alias("id"), source_key(source).alias("src"), F.xxhash64(body).alias("digest"), F.size(words(body)).cast("long").alias("size")
    )
    placed = running_totals(sized, "src", ["id", "digest"], "size", "start")
    totals = sorted((r["src"], r["size"]) for r in placed.groupBy("src").agg(F.sum("size").alias("size")).collect())
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))]
    targets = water_filled([size for _, size in totals], weights)
    sources = [Source(key, size, target, -(-size // block)) for (key, size), target in zip(totals, targets, strict=True)]
    filled = [s for s in sources if s.target > 0]
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("spot", "src", "block", (begin - F.col("start")).alias("skip"), (end - begin).alias("n"))
    drawn = draws(docs.sparkSession, filled, slots, block, seed) if filled else None
    if drawn is None:
        taken = pieces.select("spot", *[F.lit(0).cast("long").alias(n) for n in ("shard", "slot", "turn")], "block", "skip", "n").filter("false")
    else:
        # Both sides grow with the input, so neither may be broadcast for its size after compression.
        taken = pieces.join(drawn.hint("merge"), ["src", "block"]).select("spot", "shard", "slot", "turn", "block", "skip", "n")
    return placed, taken, sources


def mixed_sizes(docs: DataFrame, **names) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` of every row."""
    placed, taken, sources = planned(docs, **names)
    sums = taken.groupBy("spot").agg(F.sum("n").alias("taken"))
    spark = docs.sparkSession
    facts = spark.createDataFrame([(s.key, s.size, s.target) for s in sources], "src string, source_size long, target double")
    joined = lookup_join(placed.join(sums, "spot", "left"), facts, ["src"])
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents, all columns kept: one row for each document and pass that takes words of it.

    The text is the taken stretches of the document, in order, with its own white space inside and a line end where words between were not taken.
    ``n_chars``, where there is one, becomes the length of the new text.
    """
    placed, taken, _ = planned(docs, doc_id, text, source, **options)
    parts = taken.groupBy("spot", "turn").agg(F.sort_array(F.collect_list(F.struct("block", "skip", "n"))).alias("parts"))
    keyed = parts.join(placed.select("spot", "id", "src", "digest"), "spot")
    names = docs.columns
    identity = F.coalesce(F.concat(F.lit("i"), F.col("_id").cast("string")), F.lit("n"))
    same = ["_key", "_src", "_digest"]
    packed = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("_doc"), F.col(doc_id).alias("_id"), source_key(source).alias("_src"), F.xxhash64(whole(text)).alias("_digest")
    ).withColumn("_key", identity)
    # Rows with the same key share their places among them, so one of them, by its digest, is joined.
    hashable = [F.col("_doc")[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    packed = packed.groupBy(*same).agg(F.min_by("_doc", F.xxhash64(*hashable)).alias("_doc"))
    keyed = keyed.select(F.col("id").alias("_id"), F.col("src").alias("_src"), F.col("digest").alias("_digest"), "turn", "parts").withColumn("_key", identity)
    both = packed.join(keyed.drop("_id"), same).select("_doc", "parts")

    def stretches(tokens: Column) -> Column:
        def piece(part: Column, i: Column) -> Column:
            body = F.array_join(F.slice(tokens, (part["skip"] + 1).cast("int"), part["n"].cast("int")), "")
            after = (i > 0) & (F.get("parts", i - 1)["block"] + 1 == part["block"])
            fresh = F.regexp_replace(body, "^" + SPACE, "")
            return F.when(after, body).when(i == 0, fresh).otherwise(F.concat(F.lit("\n"), fresh))

        return F.array_join(F.transform("parts", piece), "")

    # Cut once for each text, however many pieces it gives.
    done = both.select("_doc", let(spaced_words(F.coalesce(F.col("_doc")[text].cast("string"), F.lit(""))), stretches).alias("_text"))
    fresh = {text: F.col("_text")}
    if "n_chars" in names:
        fresh["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[fresh.get(n, F.col("_doc")[n]).alias(n) for n in names])
