"""Exact top-k search by inner product: tiled matrix products, a partial selection in each tile, and a tree of merges.

Rows are packed into blocks, the queries among them into blocks of their own. A task multiplies a few query blocks with a few row blocks, one
tile (a query block times a row block) at a time. Of each tile only the scores that reach the k-th largest of their query are looked at; they
join the lists that the task keeps for its query block. The lists of a query block from all groups of row blocks are merged by fours of
fours (``vector_tiles.FAN`` at once), never all in one place.

Defined cases: vectors that are null or hold a null or non-finite component (after scaling too) take no part, neither as query nor as row. Of vectors of
different length the longer one's further components count as zero; an empty vector scores 0. A row is never its own result, but rows that repeat its
id or vector are. A null id is never a query, and loses ties. Scores outside 64-bit integers are the nearest one. Fewer than k other
rows give all of them; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_tiles import Block, Found, as_kind, each, exact_kind, grid, listed, lists, merged, query_blocks, row_blocks, whole_scores

QUERY_ROWS = 1024


def tile_best(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the ``keep`` highest of each row of a tile; of equal ones the first columns."""
    n = scores.shape[1]
    if n <= keep:
        return np.divmod(np.arange(scores.size), max(n, 1))
    least = np.partition(scores, n - keep, axis=1)[:, n - keep][:, None]
    above = scores > least
    wanted = keep - above.sum(axis=1)
    row, column = np.nonzero(scores == least)
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    level = nth < wanted[row]
    more = np.nonzero(above)
    return np.concatenate([more[0], row[level]]), np.concatenate([more[1], column[level]])


def tile_found(queries: Block, rows: Block, keep: int) -> Found:
    """The best ``keep`` rows of a row block for each query of a query block, the query's own row left out."""
    dim = min(queries.dim, rows.dim)
    kind = exact_kind(queries.norms, rows.norms)
    scores = as_kind(queries.values[:, :dim], kind) @ as_kind(rows.values[:, :dim], kind).T
    if kind is object:
        scores = whole_scores(scores)
    # One more than asked for, as the query's own row may be among them.
    i, j = tile_best(scores, keep + 1)
    other = (queries.homes[i] != rows.tile) | (queries.places[i] != j)
    i, j = i[other], j[other]
    return Found(i.astype(np.int32), whole_scores(scores[i, j]), rows.ids[j], rows.known[j])


def top_k(
    table: DataFrame, queries: Column, keep: int = 5, row_id: str = "vec_id", vector: str = "embedding", query_rows: int = QUERY_ROWS
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``keep`` highest inner products of each row for which ``queries`` holds, with all other rows."""
    rows = table.select(F.col(row_id).alias("id"), F.col(vector).alias("vector"), F.lit(0).alias("label"), queries.alias("asks"))
    blocks = row_blocks(rows)
    tiles = query_blocks(blocks, query_rows)

    def compare(row: dict, group: list[Block]) -> pa.RecordBatch:
        tile, best = Block(row), Found.none()
        for block in group:
            best = Found.joined([best, tile_found(tile, block, keep)]).best(keep)
        return lists(tile.tile, best, tile.ids)

    found, groups = grid(tiles, blocks, compare)

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each(batch):
                best, askers = listed(row)
                rank = np.arange(len(best.owner)) - np.searchsorted(best.owner, best.owner) + 1
                ids = pa.array(best.ids, mask=best.known == 0)
                yield pa.RecordBatch.from_arrays([pa.array(askers), pa.array(rank.astype(np.int32)), ids, pa.array(best.score)], ["query_id", "rank", "vec_id", "score"])

    return merged(found, groups, keep).mapInArrow(rows_of, "query_id long, rank int, vec_id long, score long")
