"""Operator 9: token-id files under Re-Pair grammar compression, with random access.

A shard is one file. All numbers are little-endian:

====================  =====================================================
``RPR1``              fixed mark
8 x u64               part, shard in the part, documents, symbols, rules, first rule id,
                      bytes of a symbol (2, 3 or 4), tokens
i64 per document      ids of documents
u8 per document       1 if the id is null
u64 per document + 1  where a document's symbols start
2 x u32 per rule      left and right side of a rule
u32 per rule          tokens that a rule expands to
symbols               token ids, or first rule id + number of the rule
====================  =====================================================

Rules never reach over the end of a document. What follows the symbols is ignored
(Spark's writer ends a file with a line break).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlens.llm.common import encoder, ids_crc32, landed, shared_path, shuffle_width

MARK = b"RPR1"
_HEAD = "<4s8Q"


# --- grammar -------------------------------------------------------------------------------


def compress(tokens: np.ndarray, end_id: int, first_rule: int,
             least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (left, right) and their expansion lengths.

    Every round counts neighbours, turns all pairs that occur at least ``least`` times
    into nonterminals and replaces them from left to right; later rounds build on earlier
    nonterminals, until no pair occurs so often. ``end_id`` enters no rule.

    Of a pair that is frequent no two symbols stay beside each other, so after the first
    round only pairs with a nonterminal of the last round can be frequent, and only they
    are counted.
    """
    symbols = tokens.astype(np.int64)
    sides = np.zeros((0, 2), np.int64)
    sizes = np.zeros(0, np.int64)
    newest = 0  # symbols from this one on are of the last round
    while len(symbols) > 1:
        changed = symbols >= newest
        free = symbols != end_id
        at = np.flatnonzero((changed[:-1] | changed[1:]) & free[:-1] & free[1:])
        key = symbols.take(at) << 32 | symbols.take(at + 1)
        ranked = np.sort(key)
        pairs = ranked[least - 1:][ranked[least - 1:] == ranked[:max(len(ranked) - least + 1, 0)]]
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
        if not len(pairs):
            break
        # A pair's number, by a slot of its own or, where frequent pairs share one, by search.
        slot = lambda k: (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        table = np.full(1 << 20, -1, np.int32)
        table[slot(pairs)] = np.arange(len(pairs))
        where = table[slot(key)]
        taken = np.flatnonzero(where >= 0)
        at, key, where = at.take(taken), key.take(taken), where.take(taken)
        other = np.flatnonzero(pairs.take(where) != key)
        if len(other):
            where[other] = np.minimum(np.searchsorted(pairs, key[other]), len(pairs) - 1)
            often = np.flatnonzero(pairs.take(where) == key)
            at, where = at.take(often), where.take(often)
        # Of pairs that overlap, take every other one from the left.
        new_run = np.r_[True, np.diff(at) != 1]
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        first = np.flatnonzero(nth & 1 == 0)
        at, where = at.take(first), where.take(first)
        used = np.bincount(where, minlength=len(pairs)) > 0  # overlaps may leave a pair no place
        newest = first_rule + len(sides)
        symbols[at] = (newest + np.cumsum(used) - 1)[where]
        symbols = np.delete(symbols, at + 1)
        new = np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], 1)
        sizes = np.r_[sizes, _widths(new, sizes, first_rule).sum(1)]
        sides = np.r_[sides, new]
    return symbols, sides, sizes


def _widths(symbols: np.ndarray, sizes: np.ndarray, first_rule: int) -> np.ndarray:
    """Tokens that each symbol expands to."""
    if not len(sizes):
        return np.ones(symbols.shape, np.int64)
    return np.where(symbols >= first_rule, sizes[np.maximum(symbols - first_rule, 0)], 1)


def _expansions(sides: np.ndarray, sizes: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules written out end to end, and where each starts."""
    starts = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    flat = np.zeros(starts[-1], np.int64)
    for r, pair in enumerate(sides.tolist()):
        at = starts[r]
        for s in pair:
            if s < first_rule:
                flat[at] = s
                at += 1
            else:
                a, b = starts[s - first_rule], starts[s - first_rule + 1]
                flat[at:at + b - a] = flat[a:b]
                at += b - a
    return flat, starts


def pack_shard(part: int, number: int, doc_ids: list[int | None], lengths: list[int], tokens: np.ndarray,
               end_id: int, first_rule: int, **how: int) -> bytes:
    symbols, sides, sizes = compress(tokens, end_id, first_rule, **how)
    width = next(n for n in (2, 3, 4) if first_rule + len(sides) <= 1 << 8 * n)
    # Each document ends with the end id, which is never replaced; so its symbols end there too.
    ends = np.zeros(len(doc_ids) + 1, np.int64)
    wide = _widths(symbols, sizes, first_rule)
    ends[1:] = np.searchsorted(np.cumsum(wide), np.cumsum(lengths)) + 1
    head = struct.pack(_HEAD, MARK, part, number, len(doc_ids), len(symbols), len(sides), first_rule,
                      width, len(tokens))
    return b"".join([
        head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(), ends.astype("<u8").tobytes(),
        sides.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), symbols.astype("<u4").view("u1").reshape(-1, 4)[:, :width].tobytes()])


class Shard:
    """A shard's tables over its bytes; nothing is expanded before it is asked for."""

    def __init__(self, data: bytes) -> None:
        (mark, self.part, self.number, n, n_symbols, n_rules, self.first_rule, width,
         self.tokens) = struct.unpack_from(_HEAD, data)
        if mark != MARK:
            raise ValueError("not a token file")
        at = struct.calcsize(_HEAD)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist())]
        self.starts = take("<u8", n + 1).astype(np.int64)
        self.sides = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.sizes = take("<u4", n_rules).astype(np.int64)
        wide = np.zeros((n_symbols, 4), "u1")
        wide[:, :width] = take("u1", n_symbols * width).reshape(-1, width)
        self.symbols = wide.view("<u4").ravel()
        flat, starts = _expansions(self.sides, self.sizes, self.first_rule)
        # Tokens stand behind the rules, so that every symbol expands to a piece of one table.
        self.flat, self.flat_starts = np.r_[flat, np.arange(self.first_rule)], np.r_[np.arange(self.first_rule) + len(flat), starts]

    def _expand(self, symbols: np.ndarray, widths: np.ndarray) -> np.ndarray:
        if not len(symbols):
            return np.zeros(0, np.int64)
        shift = self.flat_starts[symbols] - (np.cumsum(widths) - widths)
        return self.flat[np.repeat(shift, widths) + np.arange(widths.sum())]

    def document(self, i: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Token ids ``begin:end`` of the i-th document; only symbols that reach in are expanded."""
        symbols = self.symbols[self.starts[i]:self.starts[i + 1]].astype(np.int64)
        widths = _widths(symbols, self.sizes, self.first_rule)
        stops = np.cumsum(widths)
        end = int(stops[-1]) if end is None else min(end, int(stops[-1]))
        if begin >= end:
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(stops, begin, "right"), np.searchsorted(stops, end, "left") + 1
        skip = begin - (stops[a] - widths[a])
        return self._expand(symbols[a:b], widths[a:b])[skip:skip + end - begin]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the whole shard, and where each document ends."""
        symbols = self.symbols.astype(np.int64)
        widths = _widths(symbols, self.sizes, self.first_rule)
        stops = np.r_[0, np.cumsum(widths)]
        return self._expand(symbols, widths), stops[self.starts[1:]]


# --- files ---------------------------------------------------------------------------------


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id",
          text_col: str = "text", shard_tokens: int = 1 << 20) -> None:
    """Write token files of all documents to ``folder``, in ascending order of the id column.

    Parts are ranges of ids; a part is cut into shards of about ``shard_tokens`` tokens
    (a longer document makes a longer shard), so a task holds one shard at a time. A null
    text is the end id alone; null ids come first; repeated rows are written as often as
    they come; other columns are not looked at.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer, keep_stems=1 << 20)
        first_rule = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        end = np.array([end_id], enc.kind)
        ids: list[int | None] = []
        lengths: list[int] = []
        arrays: list[np.ndarray] = []
        held = 0

        def blob() -> pa.RecordBatch:
            data = pack_shard(part, number, ids, lengths, np.concatenate(arrays), end_id, first_rule)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        for batch in batches:
            for d, tokens in zip(batch.column(0).to_pylist(), enc.each(batch.column(1))):
                ids.append(d)
                lengths.append(len(tokens) + 1)
                arrays += [tokens, end]
                held += len(tokens) + 1
                if held >= shard_tokens:
                    yield blob()
                    number, held = number + 1, 0
                    ids, lengths, arrays = [], [], []
        if ids:
            yield blob()

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    (chosen.repartitionByRange(shuffle_width(docs.sparkSession), "id")
     .sortWithinPartitions("id")
     .mapInArrow(shards, "value binary")
     .select(F.col("value").cast("string").alias("value"))  # bytes as they are
     .write.option("maxRecordsPerFile", 1).text(folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document in the files: doc_id, start, n_tokens, ids_crc32, part, shard."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(data.as_py())
                tokens, ends = shard.all()
                begins = np.r_[0, ends[:-1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard.part] * len(ends), pa.int64()), pa.array([shard.number] * len(ends), pa.int64()),
                    pa.array(begins, pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(ends - begins, pa.int64()),
                    pa.array([ids_crc32(tokens[a:b]) for a, b in zip(begins, ends)], pa.int64())],
                    ["part", "shard", "inside", "doc_id", "n_tokens", "ids_crc32"])

    schema = "part long, shard long, inside long, doc_id long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").load(folder).select("content")
    rows = landed(files.mapInArrow(decode, schema), "token-rows")
    # Tokens before a shard: those of earlier parts, and of earlier shards of its part.
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = rows.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("before_part"))  # a row per part
    shards = shards.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("in_part"))
    return (rows.join(shards, ["part", "shard"]).join(parts, "part")
            .select("doc_id", (F.col("before_part") + F.col("in_part") + F.col("inside")).alias("start"),
                    "n_tokens", "ids_crc32", "part", "shard"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files to a fresh shared folder and read them back."""
    folder = shared_path(docs.sparkSession, "token-files")
    write(docs, tokenizer, end_id, folder)
    return read(docs.sparkSession, folder)
