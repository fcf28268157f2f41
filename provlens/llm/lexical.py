"""Operator 12: ranked lexical search over bit-sliced Bloom signatures.

Documents are indexed in blocks. A block holds, next to its documents' terms, one bitmap over
its documents for each slot of a Bloom filter; documents of like size share a block, so that
none fills its filter. A term's bitmaps, ANDed, say in which documents it may be and, as a term
is entered once for every level that its count reaches, at most how often. Weights summed over
these slices are upper bounds of scores; what they don't exclude is scored exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provlens.llm.common import Hasher, joined, landed, mix, slices

TOP = 50
BITS = 12  # slots for a term of a full filter
PROBES = 4
LEAST_CLASS = 6  # filters are for 2^6 terms at least
BLOCK_DOCS = 1024
BLOCK_BYTES = 1 << 22  # a block has no more text, unless it is one document
QUERY_TERMS = 1 << 16  # items are looked for together up to so many terms, an item's each counted, an item at least
QUERY_ITEMS = 1 << 12  # and up to so many items
SLOT_BYTES = 1 << 26  # of terms' slots that a task keeps, those of a class at least
BATCH_DOCS, BATCH_BLOCKS = 256, 4  # rows that travel to a worker at once
# Spark decompresses a row group as a whole, and Parquet's writer first looks at its size after 100 rows.
ROW_GROUPS = {"parquet.block.row.count.limit": str(BATCH_BLOCKS)}
# Counts that are told apart; above the last only a document's own highest count bounds them.
LEVELS = np.array([1, 2, 3, *(x << i for i in range(11) for x in (4, 6))])
_SEEDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F))

INDEX = ("ids array<long>, lengths array<long>, highest array<long>, class int, slices binary, texts array<binary>")


def _folding() -> bytes:
    """Bytes that end a term become blanks, A to Z small letters; others, and all of UTF-8 beyond ASCII, stay."""
    return bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
                 for b in range(256))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send so many rows at once to Python workers: long texts don't add up in one batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slots_of(hashes: np.ndarray, level: int, probe: int, size: int) -> np.ndarray:
    own = np.uint64((level + 1) * 0xBF58476D1CE4E5B9 % 2**64)
    return (mix((hashes + own) ^ _SEEDS[probe]) % np.uint64(size)).astype(np.int64)


def filter_size(size_class: int) -> int:
    return BITS << size_class


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of folded texts: hashes of each one's different terms, their counts, and where each text's begin.

    Terms whose hashes collide count together, which only raises bounds.
    """
    data, starts, ends, begins = joined([t.decode("utf-8") for t in texts])
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    hashes = Hasher(12).spans(data, starts, ends)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.r_[at, len(h)]), np.searchsorted(o[at], np.arange(len(texts) + 1))


@dataclass
class Block:
    """Documents of one size that are being gathered."""

    size_class: int
    docs: list[tuple[int | None, int, int, np.ndarray, np.ndarray, bytes]] = field(default_factory=list)
    size: int = 0

    def add(self, doc: tuple[int | None, int, int, np.ndarray, np.ndarray, bytes]) -> None:
        self.docs.append(doc)
        self.size += len(doc[-1])

    def full(self, more: int) -> bool:
        return bool(self.docs) and (len(self.docs) >= BLOCK_DOCS or self.size + more > BLOCK_BYTES)

    def row(self) -> tuple:
        ids, lengths, highest, hashes, counts, texts = zip(*self.docs)
        owner = np.repeat(np.arange(len(ids)), [len(h) for h in hashes])
        h, n = np.concatenate(hashes), np.concatenate(counts)
        size = filter_size(self.size_class)
        bits = np.zeros((size, len(ids) + -len(ids) % 8), bool)
        for level, least in enumerate(LEVELS):
            has = n >= least
            if not has.any():
                break
            h, n, owner = h[has], n[has], owner[has]
            for p in range(PROBES):
                bits[slots_of(h, level, p, size), owner] = True
        return list(ids), list(lengths), list(highest), self.size_class, np.packbits(bits, axis=1).tobytes(), list(texts)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents as a written table, a row per block; nothing is shuffled.

    Every row is a document, with a null or repeated id too. A null text has no terms and is
    in no block, as are texts without any. Other columns are not looked at.
    """
    table = _folding()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.binary())]

        def batch_of(block: Block) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block.row(), types)],
                                              ["ids", "lengths", "highest", "class", "slices", "texts"])

        open_blocks: dict[int, Block] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            folded = [b"" if x is None else b" ".join(x.translate(table).split()) for x in batch.column(1).to_pylist()]
            for a, b in slices(folded):
                hashes, counts, begins = term_counts(folded[a:b])
                for i, (x, y) in enumerate(zip(begins, begins[1:])):
                    if x == y:
                        continue
                    doc = (ids[a + i], int(counts[x:y].sum()), int(counts[x:y].max()), hashes[x:y].copy(), counts[x:y].copy(), folded[a + i])
                    entered = sum(int((doc[4] >= least).sum()) for least in LEVELS[:4])
                    c = max(LEAST_CLASS, (entered - 1).bit_length())
                    block = open_blocks.setdefault(c, Block(c))
                    if block.full(len(doc[-1])):
                        yield batch_of(block)
                        block = open_blocks[c] = Block(c)
                    block.add(doc)
        for block in open_blocks.values():
            yield batch_of(block)

    with batches_of(docs.sparkSession, BATCH_DOCS):
        return landed(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(run, INDEX), "lexical", **ROW_GROUPS)


@dataclass
class Items:
    """Items that are looked for together: their terms and weights, and the scores to reach."""

    numbers: list[int]
    ids: list[int | None]
    terms: dict[bytes, int]
    members: list[np.ndarray]  # an item's terms
    documents: int = 0
    length: int = 0
    weights: np.ndarray | None = None
    floors: list[int] | None = None

    def scale(self, n: np.ndarray) -> np.ndarray:
        return np.array([50 + 50 * int(x) * self.documents // self.length for x in n], np.int64)


def part(tf: np.ndarray | int, scale: np.ndarray | int) -> np.ndarray | int:
    """How much of a term's weight its count gives."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * scale)


def upper_bounds(items: Items, slots: list[list[np.ndarray]], bitmaps: np.ndarray, highest: np.ndarray,
                 scale: np.ndarray) -> np.ndarray:
    """For each item and document of a block a score that it doesn't exceed."""
    docs = len(highest)
    level = np.zeros((len(items.terms), docs), np.uint8)
    live = np.arange(len(items.terms))
    here = np.full((len(live), bitmaps.shape[1]), 0xFF, np.uint8)
    for probes in slots:
        for s in probes:
            here = here & bitmaps[s[live]]
        some = here.any(axis=1)
        live, here = live[some], here[some]
        if not len(live):
            break
        level[live] += np.unpackbits(here, axis=1, count=docs)
    # A count lies below the next level, and below the document's highest count.
    most = np.minimum(np.r_[LEVELS[1:] - 1, np.iinfo(np.int64).max][:, None], highest[None, :])
    value = part(most, scale[None, :])
    term, doc = np.nonzero(level)
    worth = items.weights[term] * value[level[term, doc].astype(np.int64) - 1, doc]
    begins = np.searchsorted(term, np.arange(len(items.terms) + 1))
    out = np.zeros((len(items.members), docs), np.int64)
    for i, members in enumerate(items.members):
        spans = [np.arange(begins[t], begins[t + 1]) for t in members]
        at = np.concatenate(spans) if spans else np.zeros(0, np.int64)
        # Sums stay below 2^53, so doubles hold them exactly.
        out[i] = np.bincount(doc[at], weights=worth[at], minlength=docs).astype(np.int64)
    return out


def _found(index: DataFrame, items: Items, keep: int) -> DataFrame:
    """Of each task the ``keep`` best documents of every item that reach its floor: number, item_id, doc_id, score."""
    sent = index.sparkSession.sparkContext.broadcast(vars(items))  # bounded by QUERY_TERMS and QUERY_ITEMS; plain, as workers may not have this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Items(**sent.value)
        names = list(q.terms)
        data, starts, ends, _ = joined([b" ".join(names).decode("utf-8")])
        hashes = Hasher(12).spans(data, starts, ends)
        slots: dict[int, list[list[np.ndarray]]] = {}
        members = [list(zip([names[t] for t in m], q.weights[m].tolist())) for m in q.members]
        best: list[list[tuple[int, bool, int]]] = [[] for _ in members]
        floors = list(q.floors)
        for batch in batches:
            columns = [batch.column(n) for n in ("ids", "lengths", "highest", "class", "slices", "texts")]
            for r in range(batch.num_rows):
                ids, c = columns[0][r].as_py(), columns[3][r].as_py()
                lengths, highest = (np.array(columns[k][r].values, np.int64) for k in (1, 2))
                bitmaps = np.frombuffer(columns[4][r].as_buffer(), np.uint8).reshape(filter_size(c), -1)
                if c not in slots:
                    while slots and (len(slots) + 1) * len(LEVELS) * PROBES * 8 * len(names) > SLOT_BYTES:
                        slots.pop(next(iter(slots)))
                    slots[c] = [[slots_of(hashes, j, p, filter_size(c)) for p in range(PROBES)] for j in range(len(LEVELS))]
                scale = q.scale(lengths)
                bounds = upper_bounds(q, slots[c], bitmaps, highest, scale)
                texts, counts = columns[5][r].values, {}
                for i in np.flatnonzero(bounds.max(axis=1) >= floors):
                    for d in np.argsort(-bounds[i], kind="stable"):
                        if bounds[i, d] < floors[i]:
                            break
                        if d not in counts:
                            counts[d] = Counter(filter(q.terms.__contains__, texts[int(d)].as_py().split()))
                        has, m = counts[d], int(scale[d])
                        score = sum(w * part(has[t], m) for t, w in members[i] if t in has)
                        if score < floors[i]:
                            continue
                        best[i].append((-score, ids[d] is None, ids[d] or 0))
                        if len(best[i]) >= 4 * keep + 64:
                            best[i] = sorted(best[i])[:keep]
                            floors[i] = max(floors[i], -best[i][-1][0])
                    if len(best[i]) > keep:
                        best[i] = sorted(best[i])[:keep]
                    if len(best[i]) == keep:
                        floors[i] = max(floors[i], -max(best[i])[0])
        rows = [(q.numbers[i], q.ids[i], None if null else d, -s) for i, found in enumerate(best) for s, null, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(4)],
                                         ["number", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "number long, item_id long, doc_id long, score long")


def _documents_with(index: DataFrame, terms: dict[bytes, int]) -> dict[int, int]:
    """In how many documents each term is, over the whole index."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        total: Counter = Counter()
        for batch in batches:
            for texts in batch.column(0):
                for x in texts.values:
                    total.update(wanted.keys() & set(x.as_py().split()))
        yield pa.RecordBatch.from_arrays([pa.array([wanted[t] for t in total], pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         ["term", "n"])

    rows = index.select("texts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r["term"]: r["n"] for r in rows}


def _grouped(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """Items with their terms, in groups of bounded size."""
    table = _folding()
    group, terms = Items([], [], {}, []), 0
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    for number, row in enumerate(rows.toLocalIterator()):
        found = list(dict.fromkeys(bytes(row["text"]).translate(table).split())) if row["text"] is not None else []
        if group.numbers and (terms + len(found) > QUERY_TERMS or len(group.numbers) >= QUERY_ITEMS):
            yield group
            group, terms = Items([], [], {}, []), 0
        if found:
            terms += len(found)
            group.numbers.append(number)
            group.ids.append(row["id"])
            group.members.append(np.array([group.terms.setdefault(t, len(group.terms)) for t in found], np.int64))
    if group.numbers:
        yield group


def search(index: DataFrame, items: DataFrame, top: int = TOP, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``top`` best documents of every item: item_id, rank, doc_id, score.

    Every row of ``items`` is an item of its own; one without terms, or whose terms are nowhere,
    finds nothing. Documents of equal score come by id, null ids last.

    Items go in groups of bounded size, a few jobs each. The first scores a few documents of
    highest bound in every task, which gives a score that the last place surely reaches; the
    second scores all documents whose bound is not below it.
    """
    spark = index.sparkSession
    ranked = []
    sizes = index.select(F.explode("lengths").alias("n")).agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    with batches_of(spark, BATCH_BLOCKS):
        few = max(2, math.ceil(4 * top / max(1, index.rdd.getNumPartitions())))
        for group in _grouped(items, item_id, text):
            if not sizes["docs"]:
                break
            group.documents, group.length = sizes["docs"], sizes["length"]
            df = _documents_with(index, group.terms)
            group.weights = np.array([math.floor(1000 * math.log((2 * group.documents + 2) / (2 * df[t] + 1))) if t in df else 0
                                      for t in range(len(group.terms))], np.int64)
            group.floors = [1] * len(group.numbers)
            place = Window.partitionBy("number").orderBy(F.desc("score"))
            sure = (_found(index, group, few).withColumn("place", F.row_number().over(place)).filter(F.col("place") == top)
                    .select("number", "score").collect())  # one row an item of the group
            at = {n: i for i, n in enumerate(group.numbers)}
            for r in sure:
                group.floors[at[r["number"]]] = max(1, r["score"])
            ranked.append(landed(_found(index, group, top), "found"))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    if not ranked:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionByName(more)
    return (out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def best_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Index all documents and rank them for every item."""
    return search(build_index(docs), items)
