"""Operator 3: packing documents into fixed-length sequences by cutting-stock column generation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provlens.functions.ordered import sequenced
from provlens.llm.common import encoder, ids_crc32, landed

UNIT = 16  # lengths are rounded up to this many tokens in the linear program


# --- the linear program --------------------------------------------------------------------


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits, by dynamic programming over the room."""
    best = np.zeros(room + 1)
    took = np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    ranked, worth = sizes[order], values[order]
    fits = np.searchsorted(ranked, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if fits[c]:
            gain = best[c - ranked[:fits[c]]] + worth[:fits[c]]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], took[c] = gain[i], order[i]
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 2e-4,
                      most: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the relaxed program uses each.

    Starts with one pattern per size; the knapsack prices a new column until none would
    lower the number of sequences by more than the share ``gap``. ``most`` ends a run that
    stalls; any of its steps is a feasible solution.
    """
    m = len(sizes)
    columns = [np.where(np.arange(m) == i, room // sizes[i], 0) for i in range(m)]
    inverse = np.diag(1.0 / np.array([columns[i][i] for i in range(m)], float))
    costs = np.ones(m)
    used = inverse @ demand
    for _ in range(most):
        prices = costs @ inverse
        worst = int(prices.argmin())
        if prices[worst] < -1e-9:  # having more room than items of a size costs nothing
            column, cost = np.where(np.arange(m) == worst, -1, 0), 0.0
        else:
            value, column = knapsack(prices, sizes, room)
            if value <= 1 + gap:
                break
            cost = 1.0
        step = inverse @ column
        rising = step > 1e-10
        if not rising.any():
            break
        ratio = np.full(m, np.inf)
        ratio[rising] = used[rising] / step[rising]
        out = int(ratio.argmin())
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        used = np.maximum(inverse @ demand, 0)
        columns[out], costs[out] = column, cost
    return [(c, float(x)) for c, x, k in zip(columns, used, costs) if k and x > 1e-9]


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of patterns (size to count) that hold exactly the items of a histogram."""
    left = {s: n for s, n in histogram.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    if not left:
        return out
    sizes = np.array(sorted(left), np.int64)
    patterns = column_generation(sizes, np.array([left[s] for s in sizes.tolist()], float), room)
    for counts, x in sorted(patterns, key=lambda p: -p[1]):
        pattern = {int(s): int(k) for s, k in zip(sizes, counts) if k > 0}
        times = min([int(x + 1e-6), *(left[s] // k for s, k in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for s, k in pattern.items():
                left[s] -= k * times
    # The fractions are left: fill sequences from the largest size down.
    while any(left.values()):
        pattern, free = {}, room
        for s in sorted(left, reverse=True):
            k = min(left[s], free // s)
            if k:
                pattern[s], free = k, free - k * s
        times = min(left[s] // k for s, k in pattern.items())
        out.append((pattern, times))
        for s, k in pattern.items():
            left[s] -= k * times
    return out


# --- documents -----------------------------------------------------------------------------


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """A row per piece of each document: doc_id, start, length, ids_crc32, doc_tokens.

    A document's ids (those of its text, then ``end_id``) are cut into pieces of ``length``
    and a rest. A null text is the end id alone; ids may be null or repeat.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind)
        for batch in batches:
            rows = []
            for d, ids in zip(batch.column(0).to_pylist(), enc.each(batch.column(1))):
                ids = np.concatenate([ids, end])
                for a in range(0, len(ids), length):
                    piece = ids[a:a + length]
                    rows.append((d, a, len(piece), ids_crc32(piece), len(ids)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(cuts: DataFrame, length: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces: every piece lies in one sequence.

    The histogram of rounded lengths (``length / 16`` rows at most, whatever the data)
    goes through the linear program on the driver. Its patterns become a small table
    that gives, for each size, which ranks of pieces go to which sequences; ranks come
    from range-partitioned slices, so a common length is no hot key.
    """
    spark = cuts.sparkSession
    size = F.ceil(F.col("length") / UNIT).cast("long")
    cuts = landed(cuts.withColumn("_size", size), "pieces")
    histogram = {r["_size"]: r["count"] for r in cuts.groupBy("_size").count().collect()}
    places, first = [], 0  # size, first rank, end, count in a sequence, first sequence, first slot
    taken = dict.fromkeys(histogram, 0)
    for pattern, times in plan(histogram, -(-length // UNIT)):
        slot = 0
        for s, k in sorted(pattern.items(), reverse=True):
            places.append((s, taken[s], taken[s] + k * times, k, first, slot))
            taken[s] += k * times
            slot += k
        first += times
    schema = "_size long, _from long, _to long, _k long, _first long, _slot long"
    table = spark.createDataFrame(places, schema)
    ranked = sequenced(cuts, ["_size"], ["doc_id", "start", "ids_crc32"])
    # At most a few entries per size and pattern: some thousand rows whatever the data.
    put = ranked.join(F.broadcast(table), "_size").filter("position >= _from AND position < _to")
    inside = F.col("position") - F.col("_from")
    put = put.withColumn("sequence_id", F.col("_first") + F.floor(inside / F.col("_k"))) \
        .withColumn("_at", F.col("_slot") + inside % F.col("_k"))
    before = Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (put.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
            .drop("_size", "_from", "_to", "_k", "_first", "_slot", "_at", "position"))


def packed_ids(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The ids of every piece, for writing out: sequence_id, offset, ids. Document ids must be unique."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(0)
            cols = dict(zip(batch.schema.names[1:], (c.to_pylist() for c in batch.columns[1:])))
            ids = [np.concatenate([x, np.array([end_id], enc.kind)])[a:a + n].astype(np.int64)
                   for x, a, n in zip(enc.each(texts), cols["start"], cols["length"])]
            yield pa.RecordBatch.from_arrays([
                pa.array(cols["sequence_id"], pa.int64()), pa.array(cols["offset"], pa.int64()),
                pa.array(ids, pa.list_(pa.int64()))], ["sequence_id", "offset", "ids"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    rows = packed.join(texts, F.col("doc_id").eqNullSafe(F.col("_id"))) \
        .select("text", "start", "length", "sequence_id", "offset")
    return rows.mapInArrow(take, "sequence_id long, offset long, ids array<long>")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    return pack(pieces(docs, tokenizer, end_id, length, id_col, text_col), length)
