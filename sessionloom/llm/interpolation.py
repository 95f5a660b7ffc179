"""Deleted-interpolation language model: train on part of the texts, score all of them.

Maximum-likelihood estimates of every order are mixed, P_k(w | h) = a f_k(w | h) + (1 - a) P_(k-1)(w | h'), down to
the uniform 1 / (V + 1). The weight ``a`` depends on the order and on the bucket (power of two) of the count of the context
``h``. Weights are learned by expectation-maximisation: the fold ``DEV`` of the training texts is held out, estimates come
from the other training texts, and the held-out events are summed by context bucket and ratio of the two estimates (in steps of 1/64 of an
octave, so the table that EM reads has a fixed size). Scores use the counts of all training texts.

How the counts meet the texts: texts are dealt to chunks by a hash. A chunk asks for its distinct n-grams, each once, with its own
counts; requests are sorted, cut by key range and sent to count shards. A shard sums each n-gram over all chunks and answers in
the order of the request, so an answer holds counts only. The chunk finds the same n-grams again and writes the counts of every
token. A frequent n-gram costs one entry per chunk wherever it occurs, and nothing is gathered on the driver but
totals, the weights and their fixed-size statistics.

N-grams are known by 64-bit keys (see ``text_bytes``).

Defined cases: null and empty texts have one token, the end. A null id counts as the empty text when folds are dealt. Repeated
rows count as often as they occur. Without held-out events a weight is taken from the bucket below, at first 0.5. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialize, release
from .text_bytes import mix, window_keys, word_keys

FOLDS, TEST, DEV = 7, 2, 3
ORDER = 2
STEPS = 64  # bins of an octave
SPAN = 48 * STEPS
ROUNDS = 60
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
CHUNKS_A_PARTITION = 2
TOTALS = -1  # the chunk that takes the totals of the shards


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, low bytes first; planes of zeros compress to nothing."""
    values = values.astype("<u8")
    width = next(w for w in (1, 2, 3, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in six bytes if they fit; no keys are the width alone."""
    if not len(keys):
        return b"\x08"
    steps = np.diff(keys, prepend=np.uint64(0))
    fits = len(steps) < 2 or int(steps[1:].max()) < 1 << 48
    if not fits:
        return b"\x08" + keys.astype("<u8").tobytes()
    return b"\x06" + keys[:1].astype("<u8").tobytes() + steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    if data[0] == 8:
        return np.frombuffer(data[1:], dtype="<u8").astype(np.uint64)
    steps = np.zeros(1 + (len(data) - 9) // 6, dtype=np.uint64)
    steps[0] = np.frombuffer(data, dtype="<u8", count=1, offset=1)[0]
    rest = np.zeros((len(steps) - 1, 8), dtype=np.uint8)
    rest[:, :6] = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, 6)
    steps[1:] = rest.reshape(-1).view("<u8")
    return np.cumsum(steps, dtype=np.uint64)


class Chunk:
    """The tokens of some texts and the keys of the n-grams that end in each token."""

    def __init__(self, texts: list[bytes | None], order: int) -> None:
        words, counts = word_keys(texts)
        self.lengths = counts + 1
        pad = order - 1
        ends = np.cumsum(counts + order) - 1  # places of the end tokens in the padded row of tokens
        tokens = np.full(len(words) + len(texts) * order, BEGIN, dtype=np.uint64)
        first = ends - counts  # places of the first words
        place = np.arange(len(words)) + np.repeat(first - (np.cumsum(counts) - counts), counts)
        tokens[place] = words
        tokens[ends] = END
        at = np.sort(np.concatenate([place, ends]))
        keys = []
        for k in range(1, order + 1):
            windows = window_keys(tokens, k) if pad or k == 1 else tokens
            # The low bits name the order, so keys of different orders differ.
            keys.append((mix(windows[at - k + 1]) & ~np.uint64(7)) | np.uint64(k))
        self.events = np.concatenate(keys)
        self.distinct, self.place = np.unique(self.events, return_inverse=True)

    def sums(self, chosen: np.ndarray, order: int) -> np.ndarray:
        """Occurrences of each distinct n-gram in the chosen texts."""
        mask = np.tile(np.repeat(chosen, self.lengths), order)
        return np.bincount(self.place[mask], minlength=len(self.distinct))


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Places where sorted keys pass from one key range to the next."""
    bounds = [(i << 64) // shards for i in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(bounds, dtype=np.uint64)), [len(keys)]]).astype(np.int64)


REQUEST = "shard int, chunk int, keys binary, fit binary, dev binary"
ANSWER = "chunk int, shard int, fit binary, whole binary"


def requests(order: int, shards: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table["text"].to_pylist(), order)
        fold = table["fold"].to_numpy()
        fit = chunk.sums((fold != TEST) & (fold != DEV), order)
        dev = chunk.sums(fold == DEV, order)
        cuts = shard_cuts(chunk.distinct, shards)
        used = np.flatnonzero(np.diff(cuts))
        parts = [slice(cuts[s], cuts[s + 1]) for s in used]
        return pa.table(
            {
                "shard": pa.array(used, pa.int32()),
                "chunk": pa.array([table["chunk"][0].as_py()] * len(used), pa.int32()),
                "keys": pa.array([packed_keys(chunk.distinct[p]) for p in parts], pa.binary()),
                "fit": pa.array([packed(fit[p]) for p in parts], pa.binary()),
                "dev": pa.array([packed(dev[p]) for p in parts], pa.binary()),
            }
        )

    return run


def answers(table: pa.Table) -> pa.Table:
    """Counts over all chunks, in the order of each request; and the totals of the shard."""
    keys = [unpacked_keys(k) for k in table["keys"].to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = []
    for name in ("fit", "dev"):
        own = np.concatenate([unpacked(c) for c in table[name].to_pylist()])
        totals.append(np.bincount(place, weights=own, minlength=len(distinct)).astype(np.int64))
    fit, whole = totals[0], totals[0] + totals[1]
    word = (distinct & np.uint64(7)) == 1
    stats = [np.array([c[word].sum(), (c[word] > 0).sum()]) for c in (fit, whole)]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    out = {
        "chunk": pa.array([*table["chunk"].to_pylist(), TOTALS], pa.int32()),
        "shard": pa.array([*table["shard"].to_pylist(), table["shard"][0].as_py()], pa.int32()),
    }
    for name, counts, total in (("fit", fit, stats[0]), ("whole", whole, stats[1])):
        out[name] = pa.array([*[packed(c) for c in np.split(counts[place], ends)], packed(total)], pa.binary())
    return pa.table(out)


def joined(order: int, schema: pa.Schema):
    """Counts of every token of every text; for the chunk of totals, one row with their sums."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("shard")
        if not texts.num_rows:
            sums = [np.sum([unpacked(b) for b in found[n].to_pylist()], axis=0) for n in ("fit", "whole")]
            row = {"id": [None], "fold": [TOTALS], "length": [0], "fit": [packed(sums[0])], "whole": [packed(sums[1])]}
            return pa.table({k: pa.array(v, schema.field(k).type) for k, v in row.items()})
        chunk = Chunk(texts["text"].to_pylist(), order)
        fold = texts["fold"].to_numpy()
        ends = np.cumsum(chunk.lengths)
        blobs = {}
        for name in ("fit", "whole"):
            counts = np.concatenate([unpacked(b) for b in found[name].to_pylist()])[chunk.place].reshape(order, -1)
            # Held-out estimates are read for the held-out fold only.
            cuts = [np.ascontiguousarray(counts[:, e - n : e]).ravel() for e, n in zip(ends, chunk.lengths, strict=True)]
            blobs[name] = [packed(c) if name == "whole" or f == DEV else None for c, f in zip(cuts, fold, strict=True)]
        return pa.table(
            {
                "id": texts["id"].combine_chunks(),
                "fold": texts["fold"].combine_chunks(),
                "length": pa.array(chunk.lengths, pa.int64()),
                "fit": pa.array(blobs["fit"], pa.binary()),
                "whole": pa.array(blobs["whole"], pa.binary()),
            }
        )

    return run


class Mixture:
    """Interpolated probabilities from the counts of a text's tokens."""

    def __init__(self, tokens: int, types: int, texts: int, weights: list[np.ndarray]) -> None:
        self.tokens, self.types, self.texts, self.weights = tokens, types, texts, weights

    def level(self, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Maximum-likelihood estimate and context count of order ``k`` (1 and up) at each token."""
        if k == 1:
            context = np.full(counts.shape[1], self.tokens)
        else:
            context = np.concatenate([[self.texts], counts[k - 2, :-1]])
        return counts[k - 1] / np.maximum(context, 1), context

    def probabilities(self, counts: np.ndarray, order: int) -> np.ndarray:
        p = np.full(counts.shape[1], 1.0 / (self.types + 1))
        for k in range(1, order + 1):
            estimate, context = self.level(counts, k)
            a = np.where(context > 0, self.weights[k - 1][buckets(context)], 0.0)
            p = a * estimate + (1 - a) * p
        return p


def buckets(context: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(context, 1)).astype(np.int64)


def held_out(counted: DataFrame, model: Mixture, k: int, order: int) -> dict[int, dict[int, int]]:
    """Held-out events of order ``k``: how many by context bucket and ratio bin (``-SPAN`` for an unseen event)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for blob in batch.column(0).to_pylist():
                counts = unpacked(blob).reshape(order, -1)
                estimate, context = model.level(counts, k)
                lower = model.probabilities(counts, k - 1)
                with np.errstate(divide="ignore"):
                    steps = np.clip(np.rint(STEPS * np.log2(estimate / lower)), -SPAN, SPAN)
                keys.append((buckets(context) * (4 * SPAN) + steps.astype(np.int64) + SPAN)[context > 0])
            cells, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

    cells = counted.filter(F.col("fold") == DEV).select("fit").mapInArrow(run, "cell long, n long")
    table: dict[int, dict[int, int]] = {}
    for row in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most 64 buckets by 2 SPAN + 1 bins
        table.setdefault(row["cell"] // (4 * SPAN), {})[row["cell"] % (4 * SPAN) - SPAN] = row["n"]
    return table


def learned(table: dict[int, dict[int, int]]) -> np.ndarray:
    """Weight of each bucket by expectation-maximisation over its held-out events."""
    weights, last = np.zeros(64), 0.5
    for bucket in range(64):
        if cells := table.get(bucket):
            steps = np.array(sorted(cells))
            n = np.array([cells[s] for s in steps.tolist()], dtype=float)
            ratio = np.where(steps > -SPAN, 2.0 ** (steps / STEPS), 0.0)
            for _ in range(ROUNDS):
                last = float((n * (last * ratio / (last * ratio + 1 - last))).sum() / n.sum())
                last = min(max(last, 1e-6), 1 - 1e-6)
        weights[bucket] = last
    return weights


def fold_of(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS).cast("int")


def token_counts(docs: DataFrame, order: int, doc_id: str, text: str) -> DataFrame:
    """``id``, ``fold``, ``length`` and the packed counts of the n-grams that end in each token, stored."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = CHUNKS_A_PARTITION * partitions
    rows = docs.select(
        F.col(doc_id).alias("id"),
        fold_of(F.col(doc_id)).alias("fold"),
        F.col(text).cast("string").cast("binary").alias("text"),
    ).withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(pieces)).cast("int"))
    asked = rows.groupBy("chunk").applyInArrow(requests(order, pieces), REQUEST)
    # The answers are stored, so that the texts' and requests' shuffle files are gone before the texts are dealt again.
    found = materialize(asked.groupBy("shard").applyInArrow(answers, ANSWER), "answers")
    release(docs.sparkSession)
    schema = T.StructType(
        [rows.schema["id"], rows.schema["fold"], *[T.StructField(n, t) for n, t in (("length", T.LongType()), ("fit", T.BinaryType()), ("whole", T.BinaryType()))]]
    )
    arrow = pa.schema([("id", to_arrow(rows.schema["id"].dataType)), ("fold", pa.int32()), ("length", pa.int64()), ("fit", pa.binary()), ("whole", pa.binary())])
    counted = rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(joined(order, arrow), schema)
    stored = materialize(counted, "counted")
    discard(found)
    return stored


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def fit_and_score(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Texts of the fold ``TEST`` are scored and never learned from. Scores are log10 probabilities of the whole text;
    ``base_score`` is the add-one unigram score.
    """
    counted = token_counts(docs, order, doc_id, text)
    totals = counted.filter(F.col("fold") == TOTALS).first()
    sums = {n: unpacked(totals[n]) if totals else np.zeros(2, np.int64) for n in ("fit", "whole")}
    number = {r["fold"]: r["n"] for r in counted.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    whole = sum(n for fold, n in number.items() if fold not in (TEST, TOTALS))
    model = Mixture(*map(int, sums["fit"]), whole - number.get(DEV, 0), [])
    for k in range(1, order + 1):
        model.weights.append(learned(held_out(counted, model, k, order)))
    final = Mixture(*map(int, sums["whole"]), whole, model.weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, base, score = [], [], []
            for blob in batch.column(2).to_pylist():
                counts = unpacked(blob).reshape(order, -1)
                known.append(int((counts[0] > 0).sum()))
                base.append(float(np.log10((counts[0] + 1) / (final.tokens + final.types + 1)).sum()))
                score.append(float(np.log10(final.probabilities(counts, order)).sum()))
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    id_field = T.StructField("doc_id", counted.schema["id"].dataType)
    numbers = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    out = T.StructType([id_field, *[T.StructField(n, t) for n, t in numbers]])
    texts = counted.filter(F.col("fold") != TOTALS).select("id", (F.col("fold") == TEST).alias("held_out"), "whole", "length")
    return texts.mapInArrow(run, out).withColumn("train_tokens", F.lit(final.tokens).cast("long"))
