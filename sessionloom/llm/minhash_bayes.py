"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact checks.

1. One pass gives each document its set of word shingles, a digest of it and a signature of ``BANDS * ROWS``
   minima. Documents with equal sets are one class, represented by the smallest id.
2. Representatives that share a band key are candidates. A band is not expanded into all pairs: its members are compared with its
   smallest member; those not yet joined to it, with a random member of each of their bands. Members that still are in another
   component than the smallest one (its *home*) are strays of that home; last, the strays of each home are compared with all of its
   component and with each other, block by block inside tasks, which send on no more than one link for a stray and component. So each
   pair of a band ends in one component or has been compared itself.
3. A comparison reads the signatures in batches of ``BATCH``. After n minima with m equal, the posterior of the similarity under a
   uniform prior is Beta(m + 1, n - m + 1); a pair is dropped as soon as the chance that it reaches the
   threshold is under ``MISS``. What survives is confirmed on the full sets.
4. Links become components.

A pair at the threshold shares no band with a chance of ``(1 - 0.8**ROWS)**BANDS``, under 1e-7.

Defined cases: null, empty and blank texts have no set, link with nothing and are kept. Texts shorter than a shingle are one
shingle. A null id is a row of its own: it joins no class, has a null component and is kept. Rows that repeat an id count once in the classes
and come out as often as they went in. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize
from .components import components
from .text_bytes import distinct, mix, window_keys, word_keys

ROWS, BANDS, BATCH, MISS = 4, 32, 16, 1e-6
HASHES = ROWS * BANDS
_draw = np.random.default_rng(7)
FACTORS = _draw.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 2**63, HASHES, dtype=np.uint64)
BLOCK = 1 << 14
STRAYS, MEMBERS = 256, 1024  # rows of a block of either side


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle keys of each text."""
    keys, counts = word_keys(texts)
    begin = 0
    for count in counts.tolist():
        words = keys[begin : begin + count]
        begin += count
        if 0 < count < width:
            words, size = np.append(words, np.uint64(count)), count + 1
            yield window_keys(words, size)
        else:
            yield distinct(window_keys(words, width))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the hash functions over a set."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for begin in range(0, len(shingles), BLOCK // 4):
        part = shingles[begin : begin + BLOCK // 4]
        values = ((part[:, None] * FACTORS + SHIFTS) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, values.min(axis=0), out=least)
    return least


def least_matches(threshold: float, miss: float) -> list[int]:
    """For n = 0, BATCH, 2 BATCH, ..: the fewest equal minima of n at which a pair is not dropped."""

    def reach(m: int, n: int) -> float:
        """P(similarity >= threshold) under Beta(m + 1, n - m + 1), as a binomial sum."""
        return sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return [next(m for m in range(n + 1) if reach(m, n) >= miss) for n in range(0, HASHES + 1, BATCH)]


def undecided(left: np.ndarray, right: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Places of the rows of two signature matrices that no batch drops."""
    needed = least_matches(threshold, miss)
    alive = np.arange(len(left))
    equal = np.zeros(len(left), dtype=np.int64)
    for step, begin in enumerate(range(0, HASHES, BATCH), 1):
        cut = slice(begin, begin + BATCH)
        equal[alive] += (left[alive, cut] == right[alive, cut]).sum(axis=1)
        alive = alive[equal[alive] >= needed[step]]
    return alive


def raw(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").cast("binary").alias("text"))


def fields(id_type: T.DataType, **types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), *[T.StructField(k, v) for k, v in types.items()]])


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """``id``, ``n`` (set size), ``key`` (digest of the set), ``sig`` of every row; key and sig null for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for shingles in shingle_sets(batch.column(1).to_pylist(), width):
                some = len(shingles) > 0
                sizes.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if some else None)
                sigs.append(signature(shingles).tobytes() if some else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "key", "sig"])

    return rows.mapInArrow(run, fields(rows.schema["id"].dataType, n=T.LongType(), key=T.BinaryType(), sig=T.BinaryType()))


def band_rows(reps: DataFrame) -> DataFrame:
    """``band`` and ``id`` for each band of each signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, BANDS, ROWS)
            keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sigs.shape[:2])
            for r in range(ROWS):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, r])
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sigs)), BANDS)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys.ravel().astype(np.int64))], ["id", "band"])

    return reps.select("id", "sig").mapInArrow(run, fields(reps.schema["id"].dataType, band=T.LongType()))


def shingle_blobs(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return rows.mapInArrow(run, fields(rows.schema["id"].dataType, shingles=T.BinaryType()))


def attach(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Pairs ``a``, ``b`` with the value of both ends as ``va``, ``vb``."""
    for end in "ab":
        pairs = pairs.join(table.select(F.col("id").alias(end), F.col(value).alias(f"v{end}")), end)
    return pairs.select("a", "b", "va", "vb")


def links_among(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""
    ends = T.StructType([T.StructField(e, pairs.schema[e].dataType) for e in "ab"])

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for i in (2, 3))
                yield batch.select(["a", "b"]).take(pa.array(undecided(left, right, percent / 100)))

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (one, two) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(one, dtype=np.uint64), np.frombuffer(two, dtype=np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    left = attach(pairs, sigs, "sig").mapInArrow(prune, ends)
    return attach(left, sets, "shingles").mapInArrow(confirm, ends)


def links_in_homes(strays: DataFrame, placed: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the strays of each home with its component and among each other."""
    left = strays.select("home", "id", "root").distinct()
    own = placed.select("id", "root").distinct().join(left.select(F.col("home").alias("root")).distinct(), "root", "left_semi")
    right = own.select(F.col("root").alias("home"), "id", "root").unionByName(left)
    n_left = left.groupBy("home").agg(F.ceil(F.count("*") / STRAYS).cast("int").alias("lefts"))
    n_right = right.groupBy("home").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("rights"))
    blocks = materialize(n_left.join(n_right, "home"), "blocks")

    def dealt(side: DataFrame, own_part: str, other_part: str) -> DataFrame:
        """Each row in the block of its id, once for every block of the other side."""
        spread = side.join(blocks, "home").withColumn(own_part[:-1], F.pmod(F.xxhash64("id"), F.col(own_part)).cast("int"))
        spread = spread.withColumn(other_part[:-1], F.explode(F.sequence(F.lit(0), F.col(other_part) - 1)))
        full = spread.select("home", "left", "right", "id", "root").join(sigs, "id").join(sets, "id")
        return full.select(*[F.col(name).alias(name) for name in full.columns])  # columns of their own for each side

    kind = left.schema["id"].dataType
    ends = T.StructType([T.StructField(e, kind) for e in "ab"])
    one, two = (dealt(*args).groupBy("home", "left", "right") for args in ((left, "lefts", "rights"), (right, "rights", "lefts")))
    found = one.cogroup(two).applyInArrow(compared(percent), ends)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def compared(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("id").type
        pairs: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, roots = right["id"].to_pylist(), right["root"].to_pylist()
            other = {r: i for i, r in enumerate(dict.fromkeys(roots))}
            root = np.array([other[r] for r in roots])
            sigs = np.frombuffer(b"".join(right["sig"].to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
            members = [np.frombuffer(s, dtype=np.uint64) for s in right["shingles"].to_pylist()]
            size = np.array([len(m) for m in members])
            for me, home, sig, blob in zip(*(left[c].to_pylist() for c in ("id", "root", "sig", "shingles")), strict=True):
                own = np.frombuffer(blob, dtype=np.uint64)
                near = np.flatnonzero((root != other.get(home, -1)) & (100 * np.minimum(size, len(own)) >= percent * np.maximum(size, len(own))))
                mine = np.broadcast_to(np.frombuffer(sig, dtype=np.uint32), (len(near), HASHES))
                near = near[undecided(mine, sigs[near], percent / 100)]
                if len(near):
                    every = np.concatenate([members[i] for i in near])
                    hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                    shared = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[near])[:-1]]), dtype=np.int64)
                    near = near[100 * shared >= percent * (len(own) + size[near] - shared)]
                    # One link to a component joins all of it.
                    _, first = np.unique(root[near], return_index=True)
                    pairs += [(me, ids[i]) for i in near[first]]
        return pa.table({e: pa.array([p[i] for p in pairs], kind) for i, e in enumerate("ab")})

    return run


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id linked, directly or not), ``kept`` of every row."""
    rows = raw(docs, doc_id, text)
    sketch = materialize(sketches(rows, width), "sketch")
    known = sketch.filter("id IS NOT NULL AND key IS NOT NULL")
    classes = known.groupBy("key").agg(F.min("id").alias("rep"))
    # An id with several texts is represented by each of them.
    reps = materialize(
        known.join(classes, "key").filter("id = rep").select("id", "key", "sig").dropDuplicates(["id", "key"]), "reps"
    )
    bands = band_rows(reps)
    crowded = bands.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first != last")
    lead = F.min_by("id", F.xxhash64("id", "band")).alias("lead")
    members = materialize(bands.join(crowded.select("band"), "band"), "members")
    leaders = materialize(members.groupBy("band").agg(F.min("id").alias("first"), lead), "leaders")
    chosen = members.select("id").distinct()
    bodies = rows.filter("id IS NOT NULL").join(chosen.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id", "text"])
    sets = materialize(shingle_blobs(bodies, width), "sets")
    sigs = reps.select("id", "sig")

    def pairs_of(found: DataFrame, other: str) -> DataFrame:
        pair = found.filter(f"id != {other}").select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b"))
        return pair.distinct()

    links = materialize(links_among(pairs_of(members.join(leaders, "band"), "first"), sigs, sets, percent), "links")
    for last in (False, True):
        roots = components(links)
        placed = members.join(roots.withColumnRenamed("root", "_root"), "id", "left").withColumn("root", F.coalesce("_root", "id"))
        placed = materialize(placed.select("band", "id", "root"), "placed")
        homes = placed.join(leaders, "band").filter("id = first").select("band", F.col("root").alias("home"), "lead").distinct()
        strays = materialize(placed.join(homes, "band").filter("root != home"), "strays")
        if strays.isEmpty():
            break
        more = links_in_homes(strays, placed, sigs, sets, percent) if last else links_among(pairs_of(strays, "lead"), sigs, sets, percent)
        links = materialize(links.unionByName(more), "links")
        discard(placed, strays)
    # Members of a class follow its representative; ids with several texts tie their classes together.
    same = known.join(classes, "key").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    several = known.groupBy("id").agg(F.min("key").alias("k1"), F.max("key").alias("k2")).filter("k1 != k2").select(F.col("id").alias("a"))
    roots = components(links.unionByName(same.join(several, "a", "left_semi")))
    found = (
        sketch.join(classes, "key", "left")
        .withColumn("rep", F.coalesce("rep", "id"))
        .join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the kept documents, all columns; of rows with equal id and text one stays. Rows without an id stay."""
    stay = near_duplicates(docs, width, percent, doc_id, text).filter("kept").select(F.col("doc_id").alias("_stay")).distinct()
    names = [F.col(f"`{n}`") for n in docs.columns]
    packed = docs.select(F.struct(*names).alias("_doc"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_digest"))
    known = packed.filter("_id IS NOT NULL").join(stay.hint("shuffle_hash"), F.col("_id") == F.col("_stay"), "left_semi")
    known = known.dropDuplicates(["_id", "_digest"])
    return known.unionByName(packed.filter("_id IS NULL")).select("_doc.*")
