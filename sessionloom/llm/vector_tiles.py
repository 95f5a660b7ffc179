"""Vectors packed into blocks, a grid of block pairs, and lists of the best scores; shared by the vector operators.

Every component x becomes ``floor(256 * x)``, x as double. A block holds up to ``ROWS`` vectors of one dimension as one binary value, so Spark
moves, stores and joins few rows. Blocks are written once: a vector is known from then on by its block and its place in it, and an
executor that is lost changes neither.

The grid puts groups of query blocks against groups of row blocks, one pair of groups a task at a time. The size of a group is bounded, so is
what a task holds; a query block is copied to each group of row blocks and the other way round, but never to all blocks.

Scores are exact: in 32-bit floats where all partial sums are integers below 2**24, in 64-bit floats below 2**53, in Python's integers beyond; what lies
outside 64-bit integers becomes the nearest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SCALE = 256.0
ROWS, ELEMENTS = 2048, 1 << 18  # of a block at most
GROUP = 32  # blocks of a side that meet in a task at most
FAN = 16  # lists merged at once
BLOCK = "n long, asked long, dim long, kind string, ids binary, known binary, labels binary, homes binary, places binary, asks binary, data binary"
LISTS = "tile long, node long, owner binary, asker binary, score binary, id binary, named binary"
INT64 = np.iinfo(np.int64)


def scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors of a list column take part, their starts and lengths, and all components scaled to whole numbers."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(SCALE * flat)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    start, end = offsets[:-1], offsets[1:]
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (bad[end] == bad[start])
    return np.flatnonzero(whole), start, end - start, flat


class Block:
    """Vectors of one dimension with their ids, labels and the places they were first written to."""

    def __init__(self, row: dict) -> None:
        self.tile, self.n, self.dim = row.get("tile"), row["n"], row["dim"]
        self.values = np.frombuffer(row["data"], dtype="<i2" if row["kind"] == "h" else "<f8").reshape(self.n, self.dim)
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.known = np.frombuffer(row["known"], dtype=np.uint8)
        self.labels = np.frombuffer(row["labels"], dtype="<i8")
        self.homes = np.frombuffer(row["homes"], dtype="<i8")
        self.places = np.frombuffer(row["places"], dtype="<i4")
        self._norms: np.ndarray | None = None

    @property
    def norms(self) -> np.ndarray:
        if self._norms is None:
            wide = self.values.astype(np.float64)
            self._norms = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        return self._norms


def packed(values: np.ndarray, ids, known, labels, homes, places, asks) -> list:
    """The fields of a block."""
    small = values.size == 0 or np.abs(values).max() < 1 << 15
    data = values.astype("<i2" if small else "<f8").tobytes()
    plain = [(ids, "<i8"), (known, "u1"), (labels, "<i8"), (homes, "<i8"), (places, "<i4"), (asks, "u1")]
    return [len(values), int(np.sum(asks)), values.shape[1], "h" if small else "d", *[np.asarray(v).astype(k).tobytes() for v, k in plain], data]


def block_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 3, pa.string(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names_of(BLOCK))


def names_of(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def each(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The rows of a batch, one in memory at a time."""
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def room(dim: int, rows: int) -> int:
    return max(1, min(rows, ELEMENTS // max(dim, 1)))


def numbered(blocks: DataFrame, label: str) -> DataFrame:
    """The blocks written once, each with a number ``tile``."""
    return materialize(blocks.withColumn("tile", F.monotonically_increasing_id()), label)


def row_blocks(rows: DataFrame) -> DataFrame:
    """Stored blocks of ``id``, ``vector``, ``label``, ``asks`` rows; those that take no part are left out.

    Rows keep the partitions they come in. Within a block they are in order of label, then id, a null id last.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, start, size, flat = scaled(batch.column(1))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            labels = batch.column(2).to_numpy(zero_copy_only=False)
            asks = batch.column(3).to_numpy(zero_copy_only=False) & known
            for dim in np.unique(size[good]).tolist():
                own = good[size[good] == dim]
                own = own[np.lexsort((ids[own], ~known[own], labels[own]))]
                step = room(dim, ROWS)
                for at in (own[b : b + step] for b in range(0, len(own), step)):
                    values = flat[start[at][:, None] + np.arange(dim)]
                    yield block_batch([packed(values, ids[at], known[at], labels[at], np.zeros(len(at)), np.arange(len(at)), asks[at])])

    plain = rows.select(F.col("id").cast("long"), "vector", F.coalesce(F.col("label").cast("long"), F.lit(0)).alias("label"), F.coalesce("asks", F.lit(False)).alias("asks"))
    return numbered(plain.mapInArrow(run, BLOCK), "blocks")


def query_blocks(blocks: DataFrame, rows: int) -> DataFrame:
    """Stored blocks of the rows that ask, up to ``rows`` each, with the block and place each row has in ``blocks``."""
    total = blocks.agg(F.sum("asked").alias("n")).first()["n"]

    def asking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each(batch):
                block, asks = Block(row), np.frombuffer(row["asks"], dtype=np.uint8)
                rows = []
                for i in np.flatnonzero(asks).tolist():
                    one = slice(i, i + 1)
                    rows.append(packed(block.values[one], block.ids[one], block.known[one], block.labels[one], [row["tile"]], [i], [1]))
                if rows:
                    yield block_batch(rows)

    def packing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Block]] = {}

        def block(parts: list[Block]) -> pa.RecordBatch:
            together = [np.concatenate([getattr(p, n) for p in parts]) for n in ("values", "ids", "known", "labels", "homes", "places")]
            return block_batch([packed(*together, np.ones(len(parts)))])

        for batch in batches:
            for row in each(batch):
                one = Block(row)
                held.setdefault(one.dim, []).append(one)
                if len(held[one.dim]) >= room(one.dim, rows):
                    yield block(held.pop(one.dim))
        for parts in held.values():
            yield block(parts)

    single = blocks.mapInArrow(asking, BLOCK)
    parts = max(1, -(-(total or 0) // rows))
    return numbered(single.repartition(parts, "homes", "places").sortWithinPartitions("labels", "homes", "places").mapInArrow(packing, BLOCK), "queries")


def grid(tiles: DataFrame, blocks: DataFrame, compare: Callable[[dict, list[Block]], pa.RecordBatch | None]) -> tuple[DataFrame, int]:
    """Lists from ``compare`` of each query block with each group of row blocks, and the number of groups.

    ``compare`` gets a row of ``tiles`` and the blocks of a group, and gives lists (see ``lists``).
    """
    spark = tiles.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = -(-tiles.count() // GROUP) or 1
    count = blocks.count()
    groups = max(1, -(-count // GROUP), min(count, -(-4 * n // columns)))

    def spread(df: DataFrame, own: str, size: int, other: str, copies: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("tile"), F.lit(size)))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))).repartition(n, "row_group", "query_group")

    left = spread(tiles, "query_group", columns, "row_group", groups).groupBy("row_group", "query_group")
    right = spread(blocks.drop("asks"), "row_group", groups, "query_group", columns).groupBy("row_group", "query_group")

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        group = [Block(r) for r in each(rows)]
        out = [compare(q, group) for q in each(queries)] if group else []
        node = rows.column("row_group")[0].as_py() if group else 0
        done = [b for b in out if b is not None]
        if not done:
            return empty_lists()
        table = pa.Table.from_batches(done)
        return table.set_column(1, "node", pa.array([node] * table.num_rows, pa.int64()))

    return left.cogroup(right).applyInArrow(run, LISTS), groups


class Found:
    """Scored rows of owners: the best ``keep`` of each owner, higher scores first, ties by smaller id, a null id last."""

    def __init__(self, owner, score, ids, known) -> None:
        self.owner, self.score, self.ids, self.known = owner, score, ids, known

    @classmethod
    def none(cls) -> Found:
        return cls(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))

    @classmethod
    def joined(cls, parts: list[Found]) -> Found:
        return cls(*[np.concatenate([getattr(p, n) for p in parts]) for n in ("owner", "score", "ids", "known")]) if parts else cls.none()

    def take(self, at: np.ndarray) -> Found:
        return Found(self.owner[at], self.score[at], self.ids[at], self.known[at])

    def best(self, keep: int) -> Found:
        order = np.lexsort((self.ids, self.known == 0, ~self.score, self.owner))
        owner = self.owner[order]
        first = np.searchsorted(owner, owner)
        return self.take(order[np.arange(len(order)) - first < keep])

    def counts(self, owners: int) -> np.ndarray:
        return np.bincount(self.owner, minlength=owners)


def lists(tile: int, found: Found, askers: np.ndarray) -> pa.RecordBatch:
    """One row for the lists of a query block."""
    plain = [(found.owner, "<i4"), (askers[found.owner], "<i8"), (found.score, "<i8"), (found.ids, "<i8"), (found.known, "u1")]
    values = [tile, 0, *[v.astype(k).tobytes() for v, k in plain]]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names_of(LISTS))


def empty_lists() -> pa.Table:
    return pa.Table.from_batches([lists(0, Found.none(), np.zeros(1, np.int64))]).slice(0, 0)


def listed(row: dict) -> tuple[Found, np.ndarray]:
    """The lists of a row and the asker of each entry."""
    found = Found(*[np.frombuffer(row[n], dtype=k) for n, k in (("owner", "<i4"), ("score", "<i8"), ("id", "<i8"), ("named", "u1"))])
    return found, np.frombuffer(row["asker"], dtype="<i8")


def merged(found: DataFrame, groups: int, keep: int) -> DataFrame:
    """One row of lists for each query block, from those of its ``groups`` groups, merged as a tree."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [listed(r) for r in rows]
        both = Found.joined([p for p, _ in parts])
        askers = np.zeros(int(both.owner.max(initial=0)) + 1, dtype=np.int64)
        for part, asker in parts:
            askers[part.owner] = asker
        out = pa.Table.from_batches([lists(rows[0]["tile"], both.best(keep), askers)])
        return out.set_column(1, "node", pa.array([rows[0]["node"]], pa.int64()))

    while groups > 1:
        groups = -(-groups // FAN)
        found = found.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("tile", "node").applyInArrow(run, LISTS)
    return found


def whole_scores(scores: np.ndarray) -> np.ndarray:
    """Exact scores as 64-bit integers, the nearest one for those outside."""
    if scores.dtype == object:
        return np.array([min(max(int(s), INT64.min), INT64.max) for s in scores.ravel()], dtype=np.int64).reshape(scores.shape)
    return scores.astype(np.int64)


def exact_kind(queries: np.ndarray, rows: np.ndarray) -> type:
    """The cheapest number type in which no sum of products of vectors with these norms is rounded."""
    most = float(queries.max(initial=0)) * float(rows.max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def as_kind(values: np.ndarray, kind: type) -> np.ndarray:
    if kind is object:
        return np.array([[int(v) for v in row] for row in values.tolist()], dtype=object).reshape(values.shape)
    return values.astype(kind)
