"""Operator 2: substring dedup behind a count-min prefilter.

Documents are written once as a bucketed table of chunks, so that what is found out about
a chunk meets its texts again without moving them:

1. Every chunk makes a count-min sketch of its window hashes and sends its cells, by bands
   of the sketch. A band merges what all chunks sent and answers each chunk which of its
   cells are counted more than once.
2. A chunk's windows whose every cell is counted twice or more are estimated repeated. Only
   those are grouped, by 96 bits of hash, to find the smallest document of each.
3. A chunk marks the words that its later copies cover and writes what is left.

A sketch counts too much at worst, so no repeated window is lost; its width follows the
size of the corpus, so the share that is passed on in vain does not grow with it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlens.llm.common import Hasher, joined, kept, lean, mix, shared_path, shuffle_width, slices, words

WINDOW = 13  # words
DEPTH = 2  # rows of the sketch
CELLS_A_WINDOW = 8
BAND_CELLS = 1 << 21  # cells that chunks send to one band, about
CHUNK_BITS = 11  # documents of a chunk, as a power of two
_ROW_SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1)
_NULL_ID = -(1 << 63)
_KEPT = ("hasher", "powers")


class Chunk:
    """Window hashes of the documents of a chunk; families of hashes are independent."""

    def __init__(self, texts: list[str | None], size: int, families: int) -> None:
        hashers = [kept(("hasher", 20 + f), lambda f=f: Hasher(20 + f)) for f in range(families)]
        self.size = size
        starts, owners, words_of = [], [], [np.zeros(1, np.int64)]
        hashes: list[list[np.ndarray]] = [[] for _ in hashers]
        offset = 0
        for a, b in slices(texts):
            data, begin, end, first = joined(texts[a:b])
            words_of.append(first[1:] + offset)
            owner = np.repeat(np.arange(a, b, dtype=np.int64), np.diff(first))
            m = max(len(owner) - size + 1, 0)
            good = owner[:m] == owner[size - 1:] if m else np.zeros(0, bool)
            starts.append(np.flatnonzero(good) + offset)
            owners.append(owner[:m][good])
            for f, h in enumerate(hashers):
                hashes[f].append(h.windows(h.spans(data, begin, end), size)[good])
            offset += len(begin)
        self.first_word = np.concatenate(words_of)  # of each document; one more than documents
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.hashes = [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in hashes]

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different cells of a row of the sketch in order, each window's place among them, and counts."""
        cell = mix(self.hashes[0] ^ np.uint64(_ROW_SEEDS[row])) >> np.uint64(64 - bits)
        return np.unique(cell, return_inverse=True, return_counts=True)


def _encode(cells: np.ndarray) -> tuple[int, bytes]:
    """Ascending different cells: low bytes as they are, high parts as steps in a bitmap.

    Takes about two or three bits a cell over the whole bytes of the mean step.
    """
    first, n = int(cells[0]), len(cells)
    rest = (cells - cells[0]).astype(np.uint64)
    width = 0
    while (int(rest[-1]) >> 8 * width) > 8 * n:
        width += 1
    high = (rest >> np.uint64(8 * width)).astype(np.int64)
    steps = np.zeros(int(high[-1]) + n, bool)
    steps[high + np.arange(n)] = True
    low = rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    return width, np.array([first, n], "<u8").tobytes() + low.tobytes() + np.packbits(steps).tobytes()


def _decode(width: int, data: bytes) -> np.ndarray:
    first, n = np.frombuffer(data, "<u8", 2).tolist()
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :width] = np.frombuffer(data, np.uint8, n * width, 16).reshape(n, width)
    steps = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, -1, 16 + n * width)))[:n]
    high = (steps - np.arange(n)).astype(np.uint64) << np.uint64(8 * width)
    return rest.view("<u8").ravel() + high + np.uint64(first)


def _bands(cells: np.ndarray, bits: int, band_bits: int) -> list[tuple[int, int, int]]:
    """Non-empty bands of ascending cells: band, begin, end."""
    band = (cells >> np.uint64(bits - band_bits)).astype(np.int64) if band_bits else np.zeros(len(cells), np.int64)
    edges = np.r_[0, np.flatnonzero(np.diff(band)) + 1, len(band)]
    return [(int(band[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if b > a]


def _half(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype(np.uint32).view(np.int32)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([_NULL_ID if v is None else v for v in column.to_pylist()], np.int64)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          depth: int = DEPTH) -> DataFrame:
    """Add ``kept_text``, ``n_words`` and ``n_removed`` to documents.

    A word goes if a window over it also starts in a document with a smaller id; windows
    are those of the input. ``kept_text`` is the other words with one space between. Null
    texts have no words; null ids count as smaller than all others; rows that share an id
    are not copies of each other. Other columns stay; ones of the three names are replaced.

    Leaves a bucketed table ``substring_<uuid>`` over files in the shared folder, which the
    result reads.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_words", "n_removed", "_chunk", "_bytes")
    name = f"substring_{uuid.uuid4().hex}"
    (docs.withColumn("_chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS))
     .withColumn("_bytes", F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long"))
     .write.bucketBy(shuffle_width(spark), "_chunk").option("compression", "zstd")
     .option("path", shared_path(spark, "chunks")).saveAsTable(name))
    table = spark.table(name)
    texts = table.select("_chunk", F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    size = table.agg(F.sum("_bytes")).first()[0] or 0
    windows = max(size // 6, 1)  # an estimate; only the load of the sketch depends on it
    bits = min(max((CELLS_A_WINDOW * windows - 1).bit_length(), 16), 60)
    band_bits = min(max((windows // BAND_CELLS).bit_length(), 4), bits)

    def send(key: tuple, chunk: pa.Table) -> pa.Table:
        lean(*_KEPT)
        own = Chunk(chunk.column("_text").to_pylist(), window, 1)
        rows = []
        for r in range(depth):
            cells, _, _ = own.cells(r, bits)
            for band, a, b in _bands(cells, bits, band_bits):
                rows.append((r << band_bits | band, key[0].as_py(), *_encode(cells[a:b])))
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                        ["band", "chunk", "width", "cells"])

    def merge(key: tuple, band: pa.Table) -> pa.Table:
        lean(*_KEPT)
        chunks, parts = band.column("chunk").to_pylist(), []
        for width, data in zip(band.column("width").to_pylist(), band.column("cells").to_pylist()):
            parts.append(_decode(width, data))
        # Each chunk sends a cell once: met twice here, it is counted in two chunks or more.
        every = np.sort(np.concatenate(parts))
        often = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for chunk, cells in zip(chunks, parts):
            at = np.searchsorted(often, cells)
            hit = at < len(often)
            hit[hit] = often[at[hit]] == cells[hit]
            if hit.any():
                out.append((chunk, key[0].as_py(), np.packbits(hit).tobytes()))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))],
                        ["_chunk", "band", "bits"])

    def candidates(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        lean(*_KEPT)
        empty = pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int32()), "_chunk": pa.array([], pa.int64()),
                          "low": pa.array([], pa.int64()), "high": pa.array([], pa.int64())})
        if not chunk.num_rows:
            return empty
        own = Chunk(chunk.column("_text").to_pylist(), window, 2)
        said = dict(zip(answers.column("band").to_pylist(), answers.column("bits").to_pylist()))
        often = np.ones(len(own.start), bool)
        for r in range(depth):
            cells, place, counts = own.cells(r, bits)
            repeated = counts > 1
            for band, a, b in _bands(cells, bits, band_bits):
                if (data := said.get(r << band_bits | band)) is not None:
                    repeated[a:b] |= np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
            often &= repeated[place]
        k1, k2 = own.hashes[0][often].view(np.int64), _half(own.hashes[1][often])
        ids = _ids(chunk.column("_id"))[own.owner[often]]
        if not len(ids):
            return empty
        order = np.lexsort((ids, k2, k1))
        k1, k2, ids = k1[order], k2[order], ids[order]
        new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(ids)] - 1
        # The largest id only where it is another one: nulls cost next to nothing to send.
        return pa.table({"k1": k1[begin], "k2": k2[begin], "_chunk": np.full(len(begin), key[0].as_py(), np.int64),
                         "low": ids[begin], "high": pa.array(ids[end], mask=ids[end] == ids[begin])})

    schema = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def remove(key: tuple, chunk: pa.Table, verdicts: pa.Table) -> pa.Table:
        lean(*_KEPT)
        texts = chunk.column(text_col).to_pylist()
        chunk = chunk.select(docs_columns)
        if verdicts.num_rows:
            own = Chunk(texts, window, 2)
            k1, k2 = (verdicts.column(c).to_numpy().astype(np.int64) for c in ("k1", "k2"))
            order = np.lexsort((k2, k1))
            both = np.stack([k1, k2], axis=1)[order].copy().view([("a", np.int64), ("b", np.int64)]).ravel()
            first = verdicts.column("first").to_numpy()[order]
            mine = np.stack([own.hashes[0].view(np.int64), _half(own.hashes[1]).astype(np.int64)], axis=1)
            near = np.flatnonzero(np.isin(mine[:, 0], k1))
            mine = mine[near].copy().view([("a", np.int64), ("b", np.int64)]).ravel()
            at = np.minimum(np.searchsorted(both, mine), len(both) - 1)
            gone = (both[at] == mine) & (_ids(chunk.column(id_col).cast(pa.int64()))[own.owner[near]] > first[at])
            cover = np.zeros(own.first_word[-1] + 1, np.int64)
            np.add.at(cover, own.start[near][gone], 1)
            np.add.at(cover, own.start[near][gone] + window, -1)
            stays = np.cumsum(cover)[:-1] == 0
        kept_texts, counts, removed = [], [], []
        for i, t in enumerate(texts):
            ws = words(t)
            n = len(ws)
            if verdicts.num_rows:
                mask = stays[own.first_word[i]:own.first_word[i + 1]]
                if not mask.all():
                    ws = [w for w, k in zip(ws, mask.tolist()) if k]
            kept_texts.append(" ".join(ws))
            counts.append(n)
            removed.append(n - len(ws))
        return (chunk.append_column("kept_text", pa.array(kept_texts, pa.string()))
                .append_column("n_words", pa.array(counts, pa.int64()))
                .append_column("n_removed", pa.array(removed, pa.int64())))

    docs_columns = docs.columns
    sent = texts.groupBy("_chunk").applyInArrow(send, "band long, chunk long, width long, cells binary")
    answers = sent.groupBy("band").applyInArrow(merge, "_chunk long, band long, bits binary")
    found = texts.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(
        candidates, "k1 long, k2 int, _chunk long, low long, high long")
    # A chunk has one row per window however often it occurs there, so no window is a hot key.
    verdicts = (found.withColumn("first", F.min("low").over(Window.partitionBy("k1", "k2")))
                .filter("coalesce(high, low) > first").select("_chunk", "k1", "k2", "first"))
    return table.groupBy("_chunk").cogroup(verdicts.groupBy("_chunk")).applyInArrow(remove, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with repeated passages cut out of their texts, columns unchanged.

    Texts of which nothing is removed stay as they are, white space included.
    """
    columns = docs.columns
    cut = dedup(docs, id_col, text_col)
    changed = F.col("n_removed") > 0
    out = cut.withColumn(text_col, F.when(changed, F.col("kept_text")).otherwise(F.col(text_col)))
    if chars_col in columns:
        out = out.withColumn(chars_col, F.when(changed, F.length(F.col("kept_text")).cast(docs.schema[chars_col].dataType))
                             .otherwise(F.col(chars_col)))
    return out.select(*[F.col(f"`{c}`") for c in columns])
