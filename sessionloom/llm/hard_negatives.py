"""Hard negatives by threshold joins over a norm-bounded inverted index.

An anchor's positives are its best rows of the same label. For every positive of score p the negatives are the best rows of other labels whose
score lies in the window ``low * p .. high * p`` (percent). Both come from the same join of anchors with rows that reach a threshold:

* The index of a block of rows lists, for each strip of ``STRIP`` dimensions, the rows to look at there. The first dimensions of a row are
  left out of it as long as their norm times the anchors' norms stays under the threshold: rows that share nothing else cannot reach it.
* Strips are read from the last to the first, adding up partial scores. A pair is dropped as soon as its partial score plus the product of the
  remaining norms of both sides stays under the threshold. What is left at the end of a row's index gets its left-out dimensions added.
* Thresholds start high and are lowered for those anchors only whose windows are not full, until they are or the bottom of the windows is reached.

This runs on the grid of ``vector_tiles``: a task lowers the thresholds until its group of row blocks has filled the windows or holds no more, and the
lists of all groups are merged as a tree. So no list is cut short: the best of every group holds the best of all.

Defined cases: rows with a null label, a null vector or a null or non-finite component (after scaling too) take no part. Of vectors of different length
the longer one's further components count as zero. A row is never its own positive; rows that repeat its id are. A null id is never an anchor
and loses ties. An anchor without another row of its label, and a positive of negative score, has no negatives. An empty table gives no rows. Scores outside
64-bit integers are the nearest one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .vector_tiles import Block, Found, as_kind, each, exact_kind, grid, listed, lists, merged, query_blocks, row_blocks, whole_scores

ANCHOR_ROWS = 512
STRIP = 8
LEVELS = (0.75, 0.5, 0.375, 0.25, 0.125)  # of the largest possible score, for positives; then all rows
STEPS = (0.75, 0.5, 0.25, 0.0)  # of the way down the lowest window, for negatives
SPARSE = 0.125  # share of pairs alive from which on pairs are followed one by one
PAIRS = 1 << 16
FIELDS = ("owner", "asker", "score", "id", "named")
HARD = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prefix_norms(values: np.ndarray) -> np.ndarray:
    """Norms of the first 0, STRIP, 2 STRIP, .. components of each vector."""
    n, dim = values.shape
    wide = np.zeros((n, -(-dim // STRIP) * STRIP))
    wide[:, :dim] = values
    sums = np.cumsum((wide * wide).reshape(n, -1, STRIP).sum(axis=2), axis=1)
    return np.sqrt(np.concatenate([np.zeros((n, 1)), sums], axis=1))


class Side:
    """Vectors of one side of a join in one number type, with their prefix norms."""

    def __init__(self, values: np.ndarray, kind: type) -> None:
        self.values, self.norms = as_kind(values, kind), prefix_norms(values)

    def take(self, at: np.ndarray) -> Side:
        out = Side.__new__(Side)
        out.values, out.norms = self.values[at], self.norms[at]
        return out


class Index:
    """Postings of some rows for a reach: ``rows[: counts[s]]`` are those listed under strip s."""

    def __init__(self, rows: Side, reach: float) -> None:
        left_out = (rows.norms[:, 1:] < reach).sum(axis=1) if reach > 0 else np.zeros(len(rows.norms), dtype=np.int64)
        self.order = np.argsort(left_out, kind="stable")
        self.rows = rows.take(self.order)
        strips = rows.norms.shape[1] - 1
        self.counts = np.searchsorted(left_out[self.order], np.arange(strips), side="right")


def rest_of(a: Side, b: Side, i: np.ndarray, j: np.ndarray, dim: int) -> np.ndarray:
    """Sums over the first ``dim`` components of pairs, some pairs at a time."""
    out = np.zeros(len(i), dtype=a.values.dtype)
    for begin in range(0, len(i), PAIRS):
        cut = slice(begin, begin + PAIRS)
        out[cut] = np.einsum("ij,ij->i", a.values[i[cut], :dim], b.values[j[cut], :dim])
    return out


def reaching(anchors: Side, rows: Side, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) and their scores, of all whose score is ``least`` of the anchor or more."""
    own = anchors.norms[:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = float(np.min(np.where(own > 0, least / own, np.where(least > 0, np.inf, -np.inf)), initial=np.inf))
    index = Index(rows, reach * (1 - 1e-6))
    partial = np.zeros((len(own), len(rows.norms)), dtype=anchors.values.dtype)
    slack = 2 + 1e-6 * float(own.max(initial=0)) * float(rows.norms[:, -1].max(initial=0))
    floor = (least - slack).astype(partial.dtype)[:, None]
    found = []

    def follow(i: np.ndarray, j: np.ndarray, dim: int) -> None:
        scores = partial[i, j] + rest_of(anchors, index.rows, i, j, dim)
        stay = scores >= least[i]
        found.append((i[stay], index.order[j[stay]], whole_scores(scores[stay])))

    listed_here = index.counts.tolist()
    for strip in range(len(listed_here) - 1, -1, -1):
        count, after = listed_here[strip], listed_here[strip - 1] if strip else 0
        if not count:
            break
        cut = slice(strip * STRIP, (strip + 1) * STRIP)
        partial[:, :count] += anchors.values[:, cut] @ index.rows.values[:count, cut].T
        bound = np.multiply.outer(anchors.norms[:, strip], index.rows.norms[:count, strip]).astype(partial.dtype)
        alive = partial[:, :count] + bound >= floor
        if strip and np.count_nonzero(alive) <= SPARSE * alive.size:
            follow(*np.nonzero(alive), cut.start)
            break
        # The index of these rows ends here.
        i, j = np.nonzero(alive[:, after:])
        follow(i, j + after, cut.start)
    if not listed_here:  # vectors without components
        i, j = np.divmod(np.arange(partial.size), max(partial.shape[1], 1))
        follow(i, j, 0)
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def joined(anchors: Block, rows: Block, at: np.ndarray, over: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``reaching`` for some places of two blocks, in their places."""
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    if not len(at) or not len(over):
        return none
    dim = min(anchors.dim, rows.dim)
    kind = exact_kind(anchors.norms[at], rows.norms[over])
    if kind is object:  # no bound is sharp enough here
        scores = whole_scores(as_kind(anchors.values[at, :dim], kind) @ as_kind(rows.values[over, :dim], kind).T)
        i, j = np.nonzero(scores >= least[:, None])
        return at[i], over[j], scores[i, j]
    i, j, scores = reaching(Side(anchors.values[at, :dim], kind), Side(rows.values[over, :dim], kind), least)
    return at[i], over[j], scores


def pairs_found(anchors: Block, group: list[Block], same: bool, at: np.ndarray, least: np.ndarray, put: Callable[[Block, tuple], None]) -> None:
    """``put`` the pairs that reach ``least`` in each block of a group, of the same label or of different ones; no anchor with itself."""
    labels = np.unique(anchors.labels[at])
    for rows in group:
        if not same and len(labels) == 1 and (rows.labels == labels[0]).all():
            continue
        if same:
            for label in labels[np.isin(labels, rows.labels)].tolist():
                own = anchors.labels[at] == label
                i, j, score = joined(anchors, rows, at[own], np.flatnonzero(rows.labels == label), least[own])
                other = (anchors.homes[i] != rows.tile) | (anchors.places[i] != j)
                put(rows, (i[other], j[other], score[other]))
        else:
            i, j, score = joined(anchors, rows, at, np.flatnonzero(~np.isin(rows.labels, labels)), least)
            put(rows, (i, j, score))
            mixed = np.flatnonzero(np.isin(rows.labels, labels)) if len(labels) > 1 else np.zeros(0, dtype=np.int64)
            i, j, score = joined(anchors, rows, at, mixed, least)
            other = anchors.labels[i] != rows.labels[j]
            put(rows, (i[other], j[other], score[other]))


def positives(anchors: Block, group: list[Block], keep: int) -> Found:
    """The best ``keep`` rows of the same label for each anchor, among the rows of a group."""
    best = Found.none()
    most = max(float(b.norms.max(initial=0)) for b in group)
    open_ = np.arange(anchors.n)
    for level in (*LEVELS, None):
        if level is None:
            least = np.full(len(open_), -np.inf)
        else:
            least = level * most * anchors.norms[open_]
        new = [Found.none()]

        def put(rows: Block, pairs: tuple) -> None:
            i, j, score = pairs
            new[0] = Found.joined([new[0], Found(i.astype(np.int32), score, rows.ids[j], rows.known[j])]).best(keep)

        pairs_found(anchors, group, True, open_, least, put)
        full = new[0].counts(anchors.n) >= keep
        done = np.ones(anchors.n, dtype=bool) if level is None else full
        best = Found.joined([best, new[0].take(done[new[0].owner])])
        open_ = open_[~full[open_]]
        if not len(open_):
            break
    return best.best(keep)


def negatives(anchors: Block, goals: Found, group: list[Block], keep: int, low: int, high: int) -> Found:
    """For each goal (a positive of an anchor) the best ``keep`` rows of other labels in its window, among the rows of a group; the goal owns them."""
    top = np.array([p * high // 100 for p in goals.score.tolist()], dtype=np.int64)
    bottom = np.array([-(-p * low // 100) for p in goals.score.tolist()], dtype=np.int64)
    best, open_ = Found.none(), np.flatnonzero(bottom <= top)
    for step in STEPS:
        if not len(open_):
            break
        at = np.unique(goals.owner[open_])
        place = np.searchsorted(at, goals.owner[open_])
        # Down a share of the way from the lowest positive to the bottom of its window.
        lowest, ceiling = np.full(len(at), np.inf), np.full(len(at), np.inf)
        np.minimum.at(lowest, place, bottom[open_])
        np.minimum.at(ceiling, place, top[open_])
        least = np.floor(lowest + step * (ceiling - lowest))
        new = [Found.none()]
        nth = np.arange(len(open_)) - np.searchsorted(goals.owner[open_], goals.owner[open_])
        windows = []
        for turn in range(int(nth.max()) + 1):  # the first open window of every anchor, the second, ..
            own = open_[nth == turn]
            slot, lo, hi = np.full(anchors.n, -1), np.zeros(anchors.n, np.int64), np.full(anchors.n, -1)
            slot[goals.owner[own]], lo[goals.owner[own]], hi[goals.owner[own]] = own, bottom[own], top[own]
            windows.append((slot, lo, hi))

        def put(rows: Block, pairs: tuple) -> None:
            i, j, score = pairs
            parts = [new[0]]
            for slot, lo, hi in windows:
                inside = (slot[i] >= 0) & (score >= lo[i]) & (score <= hi[i])
                parts.append(Found(slot[i[inside]].astype(np.int32), score[inside], rows.ids[j[inside]], rows.known[j[inside]]))
            new[0] = Found.joined(parts).best(keep)

        pairs_found(anchors, group, False, at, least, put)
        full = (new[0].counts(len(goals.score)) >= keep) | (step == 0.0)
        full[open_] |= bottom[open_] >= least[place]
        best = Found.joined([best, new[0].take(full[new[0].owner])])
        open_ = open_[~full[open_]]
    return best.best(keep)


def mine(
    table: DataFrame,
    anchors: Column,
    n_positives: int = 5,
    n_negatives: int = 5,
    low: int = 80,
    high: int = 100,
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` for the rows where ``anchors`` holds."""
    rows = table.filter(F.col(label).isNotNull())
    blocks = row_blocks(rows.select(F.col(row_id).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"), anchors.alias("asks")))
    tiles = query_blocks(blocks, anchor_rows)

    def best_of_label(row: dict, group: list[Block]) -> pa.RecordBatch:
        tile = Block(row)
        return lists(tile.tile, positives(tile, group, n_positives), tile.ids)

    first, groups = grid(tiles, blocks, best_of_label)
    goals = materialize(merged(first, groups, n_positives).drop("node"), "positives")

    def best_of_others(row: dict, group: list[Block]) -> pa.RecordBatch:
        tile = Block(row)
        own, _ = listed(row)
        return lists(tile.tile, negatives(tile, own, group, n_negatives, low, high), np.zeros(len(own.owner), dtype=np.int64))

    second, groups = grid(tiles.join(goals.hint("merge"), "tile"), blocks, best_of_others)
    found = merged(second, groups, n_negatives).select("tile", *[F.col(n).alias(f"n_{n}") for n in FIELDS])

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each(batch):
                own, askers = listed(row)
                hard, _ = listed({n: row[f"n_{n}"] for n in FIELDS})
                goal = hard.owner
                rank = np.arange(len(goal)) - np.searchsorted(goal, goal) + 1
                columns = [askers[goal], (own.ids[goal], own.known[goal]), rank.astype(np.int32), (hard.ids, hard.known), own.score[goal], hard.score]
                arrays = [pa.array(c[0], mask=c[1] == 0) if isinstance(c, tuple) else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in HARD.split(", ")])

    return goals.join(found.hint("merge"), "tile").mapInArrow(rows_of, HARD)
