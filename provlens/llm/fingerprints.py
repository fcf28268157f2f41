"""Operator 10: document fingerprints that subtract: invertible Bloom lookup sketches of paragraphs.

A paragraph is a line; a long line is cut after every word whose hash ends in three zero
bits, so an edit changes few pieces. Each piece's digest goes into three cells of a sketch
that hold a count, the sum of digests and the sum of check hashes. Subtracting two sketches
leaves the digests that only one version has; cells with a single one give it away, and
peeling those recovers the rest. Where more digests differ than the cells can hold, the
sketches of both texts are made again with four times the cells.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens.llm.common import Hasher, joined, kept, mix, shuffle_width, slices

CELLS = 24  # of a fingerprint; 16 bytes each
_SEEDS = (0x51A7C3E9, 0x2F6D1B85, 0x7E93A04D)
_CHECK = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)


def pieces(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of the pieces of each text: number of the text and digest, in order.

    Pieces cover a text with its white space, so different texts differ in one. An empty
    text has none.
    """
    hasher = kept(("hasher", 10), lambda: Hasher(10))
    data, starts, ends, first = joined(texts)
    lines = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=lines[1:])
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts], out=begins[1:])
    cut = np.zeros(len(starts), bool)
    if len(starts) > 1:
        words = hasher.spans(data, starts, ends)
        cut[1:] = (lines[starts[1:]] > lines[ends[:-1]]) | ((words[:-1] & np.uint64(7)) == 0)
    cut[first[:-1][first[:-1] < first[1:]]] = False  # a text's first piece starts with the text
    full = np.flatnonzero(np.diff(begins) > 1)
    owner = np.searchsorted(first, np.flatnonzero(cut), "right") - 1
    at = np.concatenate([begins[:-1][full], starts[cut]])
    text = np.concatenate([full, owner])
    order = np.lexsort((at, text))
    at, text = at[order], text[order]
    stops = np.r_[at[1:], begins[-1]]
    last = np.r_[text[1:] != text[:-1], True] if len(text) else np.zeros(0, bool)
    stops[last] = begins[1:][text[last]]
    digests = hasher.spans(data, at, stops)
    order = np.lexsort((digests, text))
    text, digests = text[order], digests[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (digests[1:] != digests[:-1])
    return text[new], digests[new]


class Sketches:
    """A sketch for each of ``n`` texts, ``cells`` cells each."""

    def __init__(self, n: int, cells: int) -> None:
        self.n, self.cells = n, cells - cells % 3
        self.count = np.zeros(n * self.cells, np.int64)
        self.total = np.zeros(n * self.cells, np.uint64)
        self.check = np.zeros(n * self.cells, np.uint64)

    def _places(self, rows: np.ndarray, digests: np.ndarray) -> np.ndarray:
        third = self.cells // 3
        return np.concatenate([rows * self.cells + j * third + (mix(digests ^ np.uint64(s)) % np.uint64(third)).astype(np.int64)
                               for j, s in enumerate(_SEEDS)])

    def add(self, rows: np.ndarray, digests: np.ndarray, sign: np.ndarray) -> None:
        at = self._places(rows, digests)
        signed = sign.astype(np.int64)
        np.add.at(self.count, at, np.tile(signed, 3))
        np.add.at(self.total, at, np.tile(digests * signed.astype(np.uint64), 3))
        np.add.at(self.check, at, np.tile((mix(digests ^ _CHECK) & _LOW) * signed.astype(np.uint64), 3))

    def strings(self) -> list[str]:
        """Each sketch as text: per cell count (4 bytes), digests (8), checks (4), little-endian."""
        raw = np.zeros(self.n * self.cells, [("c", "<i4"), ("t", "<u8"), ("k", "<u4")])
        raw["c"], raw["t"], raw["k"] = self.count, self.total, self.check & _LOW
        width = self.cells * 16
        data = raw.tobytes()
        return [base64.b64encode(data[i * width:(i + 1) * width]).decode("ascii") for i in range(self.n)]

    @classmethod
    def from_strings(cls, texts: list[str]) -> Sketches:
        data = [base64.b64decode(t) for t in texts]
        out = cls(len(data), len(data[0]) // 16 if data else 3)
        raw = np.frombuffer(b"".join(data), [("c", "<i4"), ("t", "<u8"), ("k", "<u4")])
        out.count, out.total, out.check = raw["c"].astype(np.int64), raw["t"].copy(), raw["k"].astype(np.uint64)
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.total = self.count - other.count, self.total - other.total
        out.check = (self.check - other.check) & _LOW
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take the sketches apart: rows, digests and signs (1: left only), and which rows came out whole."""
        rows_out, digests_out, signs_out = [], [], []
        limit = 2 * self.cells
        for _ in range(limit):
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            digest = self.total[at] * sign.astype(np.uint64)
            want = (mix(digest ^ _CHECK) & _LOW) * sign.astype(np.uint64)
            pure = ((self.check[at] - want) & _LOW) == 0
            at, sign, digest = at[pure], sign[pure], digest[pure]
            if not len(at):
                break
            rows = at // self.cells
            _, one = np.unique(np.stack([rows.astype(np.uint64), digest]), axis=1, return_index=True)
            rows, digest, sign = rows[one], digest[one], sign[one]
            self.add(rows, digest, -sign)
            rows_out.append(rows)
            digests_out.append(digest)
            signs_out.append(sign)
        rest = (self.count != 0) | (self.total != 0) | ((self.check & _LOW) != 0)
        whole = ~rest.reshape(self.n, self.cells).any(axis=1)
        if not rows_out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), whole
        return np.concatenate(rows_out), np.concatenate(digests_out), np.concatenate(signs_out), whole


def sketch(text: np.ndarray, digests: np.ndarray, n: int, cells: int = CELLS) -> Sketches:
    out = Sketches(n, cells)
    out.add(text, digests, np.ones(len(text), np.int64))
    return out


def difference(a: str, b: str) -> tuple[set[int], set[int]] | None:
    """Digests that only ``a`` and only ``b`` has, from two fingerprints; None if they are too many."""
    rows, digests, signs, whole = Sketches.from_strings([a]).minus(Sketches.from_strings([b])).peel()
    if not whole[0]:
        return None
    return set(digests[signs > 0].tolist()), set(digests[signs < 0].tolist())


def _runs(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


def _pick(runs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the digests of the texts ``rows``, and which of ``rows`` each is for."""
    sizes = runs[rows + 1] - runs[rows]
    which = np.repeat(np.arange(len(rows)), sizes)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(runs[rows], sizes) + inside, which


def likeness(owner: np.ndarray, digests: np.ndarray, base: Sketches, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard likeness of the digest sets of texts ``left`` and ``right``, out of their sketches.

    Starts from the fingerprints; pairs that do not come apart are sketched anew with four
    times the cells, until they do. Two empty texts are alike.
    """
    runs = _runs(owner, base.n)
    sizes = runs[1:] - runs[:-1]
    differ = np.full(len(left), -1, np.int64)
    todo, cells = np.arange(len(left)), base.cells
    while len(todo):
        diff = Sketches(len(todo), cells)
        if cells == base.cells:
            grid = lambda x, r: x.reshape(base.n, cells)[r].ravel()
            diff.count = grid(base.count, left) - grid(base.count, right)
            diff.total = grid(base.total, left) - grid(base.total, right)
            diff.check = (grid(base.check, left) - grid(base.check, right)) & _LOW
        else:
            for side, sign in ((left, 1), (right, -1)):
                at, which = _pick(runs, side[todo])
                diff.add(which, digests[at], np.full(len(at), sign, np.int64))
        rows, _, _, whole = diff.peel()
        found = np.bincount(rows, minlength=len(todo))
        differ[todo[whole]] = found[whole]
        todo, cells = todo[~whole], cells * 4
    both = sizes[left] + sizes[right]
    return np.where(both + differ == 0, 1.0, (both - differ) / np.maximum(both + differ, 1))


def fingerprints(docs: DataFrame, text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Add ``fingerprint`` to documents; equal texts have equal ones, a null text that of the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            made: list[str] = []
            for a, b in slices(texts):
                made += sketch(*pieces(texts[a:b]), b - a, cells).strings()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())],
                                             [*batch.schema.names, "fingerprint"])

    from pyspark.sql import types as T
    if "fingerprint" in docs.columns:
        docs = docs.drop("fingerprint")
    schema = T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())])
    return docs.mapInArrow(run, schema)


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of an edited version of it, and likeness.

    The edited version takes the place of the last half of a text (rounded down) by the
    beginning of the next document by id; the last is followed by the first. Null texts are
    empty, null ids come first, rows of one id are ordered by text; other columns are left out.

    Documents are dealt by ranges of ids, with each range's first document also sent to the
    range before it: texts move once, and a task holds half a million characters at a time.
    """
    spark = docs.sparkSession
    n = shuffle_width(spark)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = chosen.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / n for i in range(1, n)], 0.2 / n)
    bounds = sorted({int(b) for b in bounds})
    place = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("doc_id"))) \
        if bounds else F.lit(0)
    dealt = chosen.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place).cast("long"))
    # A row per range: at most as many as there are partitions.
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("f")) \
        .orderBy("bucket").collect()
    pairs = [(firsts[i]["f"]["doc_id"], firsts[i - 1]["bucket"]) for i in range(len(firsts))]
    before = F.broadcast(spark.createDataFrame(pairs, "_first long, _before long"))
    sent = (dealt.join(before, F.col("doc_id").eqNullSafe(F.col("_first")), "left")
            .withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.array(F.struct("bucket", F.lit(0).alias("extra"))))
                                         .otherwise(F.array(F.struct("bucket", F.lit(0).alias("extra")),
                                                            F.struct(F.col("_before").alias("bucket"), F.lit(1).alias("extra"))))))
            .select("_to.bucket", "_to.extra", "doc_id", "text"))

    def work(jobs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        m = len(jobs)
        edited = [t[:len(t) - len(t) // 2] + nxt[:len(t) // 2] for _, t, nxt in jobs]
        texts = [t for _, t, _ in jobs] + edited
        following = []
        for i, (_, _, nxt) in enumerate(jobs):
            if i + 1 < m and jobs[i + 1][1] is nxt:
                following.append(i + 1)
            else:
                following.append(len(texts))
                texts.append(nxt)
        owner, digests = pieces(texts)
        base = sketch(owner, digests, len(texts))
        here = np.arange(m)
        strings = base.strings()
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _, _ in jobs], pa.int64()), pa.array([len(t) for _, t, _ in jobs], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]),
            pa.array(strings[:m]), pa.array(strings[m:2 * m]),
            pa.array(likeness(owner, digests, base, here, here + m)),
            pa.array(likeness(owner, digests, base, here, np.array(following, np.int64)))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs: list[tuple[int | None, str, str]] = []
        held, last = 0, None
        for batch in batches:
            for bucket, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[0] == bucket and not last[1]:
                    jobs.append((last[2], last[3], text))
                    held += len(text) + len(last[3])
                    if held > 1_000_000 or len(jobs) >= 2000:
                        yield work(jobs)
                        jobs, held = [], 0
                last = (bucket, extra, doc_id, text)
        if jobs:
            yield work(jobs)

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return (sent.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "extra", "doc_id", "text")
            .mapInArrow(run, schema))
