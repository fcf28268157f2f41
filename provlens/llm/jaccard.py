"""Operator 5: near-duplicate documents by the Jaccard likeness of their word n-grams.

1. Documents with the same words are one text; from here on texts are compared.
2. Texts that agree in a band of MinHash values are candidates. A bucket links its texts to
   its smallest only, and connected texts form a neighbourhood.
3. Inside a neighbourhood, texts that share a band are compared a few MinHash values at a
   time; a pair is dropped as soon as the posterior probability that it reaches the
   threshold falls below a tolerance. The rest is verified on the whole n-gram sets.
4. Links are counted, and joined to classes, where they are found; pairs never become rows.
   A large neighbourhood is cut into blocks, and every two blocks meet in a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens.llm.common import Hasher, joined, kept, landed, lean, mix, slices
from provlens.llm.components import components

WORDS = 5  # of an n-gram
THRESHOLD = 0.8
BANDS, ROWS = 30, 5  # at the threshold, one pair in 150,000 shares no band
STEP = 15  # MinHash values compared at a time
TOLERANCE = 1e-6  # posterior probability below which a pair is dropped
BLOCK_TEXTS, BLOCK_GRAMS = 1024, 400_000
_KEPT = ("hasher", "minhash", "powers")


def grams(texts: list[str | None], size: int = WORDS) -> list[tuple[bytes | None, np.ndarray]]:
    """For each text a digest of its words (None: it has none) and its distinct n-gram hashes.

    A text of fewer words than an n-gram has one, of all its words.
    """
    hasher = kept(("hasher", 50), lambda: Hasher(50))
    data, starts, ends, first = joined(texts)
    spans = hasher.spans(data, starts, ends)
    out: list[tuple[bytes | None, np.ndarray]] = []
    raw = data.tobytes()
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if a == b:
            out.append((None, np.zeros(0, np.uint64)))
            continue
        text = b" ".join(raw[starts[a]:ends[b - 1]].split())
        out.append((hashlib.blake2b(text, digest_size=16).digest(),
                    np.unique(hasher.windows(spans[a:b], min(size, b - a)))))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` MinHash values."""
    a, b = kept(("minhash",), lambda: (
        np.random.default_rng(5).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
        np.random.default_rng(6).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)))
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (x[at:at + 2048, None] * a + b).min(axis=0), out=out)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """A hash per band, different between bands."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        out = mix(out ^ (parts[:, :, r] + np.uint64(r << 32)))
    return out


def least_matches(threshold: float, tolerance: float, step: int = STEP, most: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """After how many values a pair must agree in how many, to stay.

    Under a flat prior, the posterior probability of a likeness of ``threshold`` or more after
    ``m`` matches in ``n`` values is that of at most ``m`` successes in ``n + 1`` trials at
    ``threshold``.
    """
    out = []
    for n in range(step, most + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def compare(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float,
            needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``left`` and ``right`` (rows of ``sigs``) that reach the threshold; each once."""
    keys = bands(sigs)
    agree = np.zeros((len(left), len(right)), bool)
    for k in range(BANDS):
        agree |= keys[left, k][:, None] == keys[right, k][None, :]
    sizes = np.array([len(s) for s in sets], np.int64)
    small = np.minimum(sizes[left][:, None], sizes[right][None, :])
    agree &= small >= threshold * np.maximum(sizes[left][:, None], sizes[right][None, :]) - 1e-9
    if left is right:
        agree &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    a, b = (x.astype(np.int64) for x in np.nonzero(agree))
    a, b = left[a], right[b]
    matches = np.zeros(len(a), np.int64)
    before = 0
    for n, least in needed:
        matches += (sigs[a, before:n] == sigs[b, before:n]).sum(axis=1)
        stay = matches >= least
        a, b, matches, before = a[stay], b[stay], matches[stay], n
    if not len(a):
        return a, b
    common = _common(sets, a, b)
    fine = common >= threshold * (sizes[a] + sizes[b] - common) - 1e-9
    return a[fine], b[fine]


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many n-grams each pair has in common, exactly."""
    if len(a) <= 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    rows_a, place_a = np.unique(a, return_inverse=True)
    rows_b, place_b = np.unique(b, return_inverse=True)
    used = np.unique(np.r_[rows_a, rows_b])
    every = np.concatenate([sets[i] for i in used])
    grams_met, counts = np.unique(every, return_counts=True)
    shared = grams_met[counts > 1]
    total = np.zeros((len(rows_a), len(rows_b)), np.float32)

    def incidence(rows: np.ndarray, at: int, width: int) -> np.ndarray:
        out = np.zeros((len(rows), width), np.float32)
        lo, hi = shared[at], shared[at + width - 1]
        for k, i in enumerate(rows):
            s = sets[i][np.searchsorted(sets[i], lo):np.searchsorted(sets[i], hi, "right")]
            place = np.searchsorted(shared, s)
            good = place < len(shared)
            good[good] = shared[place[good]] == s[good]
            out[k, place[good] - at] = 1
        return out

    for at in range(0, len(shared), 4096):
        width = min(4096, len(shared) - at)
        total += incidence(rows_a, at, width) @ incidence(rows_b, at, width).T
    return np.rint(total[place_a, place_b]).astype(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
            tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class) and n_links.

    Documents are linked when the Jaccard likeness of their sets of five-word n-grams is
    ``threshold`` or more; a class is what links connect; ``n_links`` counts the documents a
    document is linked to, copies included. A document without words is a class of its own
    without links. Null ids are smaller than all others. Rows that share an id are documents
    of their own.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lean(*_KEPT)
            ids, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                found = grams(texts[a:b])
                full = [f for _, f in found]
                keys = bands(np.stack([signature(f) for f in full])).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[a:b], pa.int64()), pa.array([k for k, _ in found], pa.binary()),
                    pa.array([len(f) for f in full], pa.int64()),
                    pa.array([list(k) if len(f) else [] for k, f in zip(keys, full)], pa.list_(pa.int64()))],
                    ["doc_id", "node", "n", "bands"])

    rows = landed(chosen.mapInArrow(outline, "doc_id long, node binary, n long, bands array<long>"), "outlines")
    least_id = F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id"))["doc_id"]
    texts = landed(rows.filter("node IS NOT NULL").groupBy("node")
                   .agg(least_id.alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"),
                        F.first("bands").alias("bands")), "texts")
    members = texts.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("w")).filter("v < w").drop("w")
    near = components(members.join(buckets, "band").select(F.col("node").alias("u"), "v"))

    info = near.join(texts.select("node", "first", "copies", "n"), "node")
    # Written, like the names below, so that the join deals both sides anew and can split a large neighbourhood.
    parts = landed(info.groupBy("label").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_TEXTS)).alias("parts")), "parts")
    dealt = info.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))) \
        .withColumnRenamed("first", "_id")
    needed = least_matches(threshold, tolerance)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lean(*_KEPT)
            cols = {n: c for n, c in zip(batch.schema.names, batch.columns)}
            texts_here, nodes = cols["text"].to_pylist(), cols["node"].to_pylist()
            for a, b in slices(texts_here):
                found = grams(texts_here[a:b])
                # Another text under the same id is not this one.
                good = [i for i in range(b - a) if found[i][0] == nodes[a + i]]
                if good:
                    at = pa.array([a + i for i in good])
                    yield pa.RecordBatch.from_arrays([
                        *(cols[c].take(at) for c in ("label", "node", "parts", "part", "copies")),
                        pa.array([signature(found[i][1]).tobytes() for i in good], pa.binary()),
                        pa.array([found[i][1].tobytes() for i in good], pa.binary())],
                        ["label", "node", "parts", "part", "copies", "signature", "grams"])

    measured = (chosen.join(dealt, F.col("doc_id").eqNullSafe(F.col("_id")))
                .select("text", "label", "node", "parts", "part", "copies")
                .mapInArrow(measure, "label binary, node binary, parts long, part long, copies long, signature binary, grams binary"))
    # Every two parts of a neighbourhood meet once; nearly all have one part.
    meeting = (measured.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
               .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")))

    def meet(key: tuple, block: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        nodes = block.column("node").to_pylist()
        one = list({n: i for i, n in enumerate(nodes)}.values())  # repeated rows
        part = block.column("part").to_numpy()[one]
        nodes = [nodes[i] for i in one]
        sigs = np.stack([np.frombuffer(x.as_py(), np.uint32) for x in block.column("signature")])[one]
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in block.column("grams")]
        sets = [sets[i] for i in one]
        copies = block.column("copies").to_numpy()[one]
        left = np.flatnonzero(part == low)
        right = left if low == high else np.flatnonzero(part == high)
        a, b = compare(sigs, sets, left, right, threshold, needed)
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = _roots(len(nodes), a, b)
        met = np.flatnonzero(links)
        return pa.table([pa.array([nodes[i] for i in met], pa.binary()), pa.array([nodes[root[i]] for i in met], pa.binary()),
                         pa.array(links[met], pa.int64())], ["node", "root", "links"])

    found = landed(meeting.groupBy("label", "low", "high").applyInArrow(meet, "node binary, root binary, links long"), "met")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = landed(groups.join(texts.select("node", "first"), "node").groupBy("label").agg(
        F.min(F.struct(F.col("first").isNotNull().alias("k"), "first"))["first"].alias("class_id")), "names")
    placed = groups.join(named, "label").select("node", "class_id", F.lit(True).alias("_grouped"))
    # Written, so that the join below deals both sides anew and can split a text with many copies.
    whole = landed(texts.select("node", "first", "copies").join(placed, "node", "left").join(linked, "node", "left")
                   .select("node", F.when(F.col("_grouped"), F.col("class_id")).otherwise(F.col("first")).alias("class_id"),
                           (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    own = rows.filter("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return (rows.filter("node IS NOT NULL").select("doc_id", "node").join(whole, "node")
            .select("doc_id", "class_id", "n_links").union(own))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each class, columns unchanged.

    What goes is decided by row: of rows that share the smallest id (repeated rows, null ids)
    one stays, and rows of one id with different texts are judged on their own.
    """
    number = "_one_of_each_row"
    # Written, so that a row has the same number wherever it is read.
    rows = landed(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    ids = rows.select(F.col(number).alias("doc_id"), F.col(id_col).cast("long").alias("_id"))
    first = (classes(rows, number, text_col).join(ids, "doc_id").groupBy("class_id")
             .agg(F.min(F.struct(F.col("_id").isNotNull().alias("k"), "_id", "doc_id"))["doc_id"].alias(number)))
    return rows.join(first.select(number), number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
