"""Operator 6: SentencePiece encoding and decoding as a relational lattice.

1. A text is cut into words by its blanks, and words where two characters meet that stand beside
   each other in no piece: no edge leads over such a place, so the lattice falls apart there.
   Every different part is dealt to a task by its hash and encoded once.
2. A part's substrings are joined to the piece table, a character at a time: a prefix and its next
   character meet the table's prefixes. What matches is an edge of the part's lattice, from one
   position to another.
3. Edges are grouped by part and folded, many parts side by side. For a unigram model
   the fold is Viterbi: the best path to each position is the best of those that end there.
   For a model whose scores rank merges, the fold keeps a part's boundaries and takes, again
   and again, the best edge over two neighbouring symbols: the best path by summed ranks is
   another one for more than half of all words.
4. The ids of parts go back to the documents that have them.

Parts of more than 60 characters (text without blanks) are encoded where their text is: a fold
over all edges takes time with the square of a word's length and more, a heap touches only a
merge's neighbours.

Characters that no piece covers become their bytes' pieces.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlens.llm.common import kept, lean, runs, shared_path, shuffle_width, slices

BLANK = "▁"  # fixed value: stands for a space in pieces
CHUNK_BITS = 11
BYTE_SCORE = -1e6  # of a character written as bytes, below any piece
_CUT = re.compile(f"[\n\t\r]|{BLANK}+[^{BLANK}\n\t\r]*|[^{BLANK}\n\t\r]+")


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model: piece, id and score; ids of bytes; the longest piece."""

    rows: list[tuple[str, int, float]]
    bytes_at: list[int]
    longest: int
    texts: list[str]
    merges: bool  # scores rank merges

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rows, bytes_at, texts = [], [0] * 256, []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            texts.append(piece)
            if model.is_byte(i):
                bytes_at[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rows.append((piece, i, model.get_score(i)))
        return cls(rows, bytes_at, max(len(p) for p, _, _ in rows), texts, _ranks_merges(path))


def _ranks_merges(path: str) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto.trainer_spec.model_type == proto.trainer_spec.BPE


def cut(text: str) -> list[str]:
    """The words of a text, each with the blanks before it; a blank is put in front of the text.

    Line breaks and tabs are words of their own. Put end to end, the words are the text.
    """
    if not text:
        return []
    if text[0] == " " or any(x in text for x in ("  ", "\t", "\r", "\0", BLANK)):
        return _CUT.findall(BLANK + text.replace(" ", BLANK))
    # Blanks one by one and line breaks only: words begin where a mark is put.
    return [w for w in (BLANK + text.replace(" ", "\0" + BLANK).replace("\n", "\0\n\0")).split("\0") if w]


SHORT = 60  # characters of a part that is sent to the fold
SLICE = 1 << 17  # characters of the parts that are folded side by side


class Prefixes:
    """The piece table by prefixes: where a prefix and a next character lead, and the piece that ends there."""

    def __init__(self, pieces: Pieces) -> None:
        nodes: dict[tuple[int, int], int] = {}
        ids, scores = [-1], [0.0]
        for piece, i, score in pieces.rows:
            at = 0
            for c in map(ord, piece):
                if (at, c) not in nodes:
                    nodes[at, c] = len(ids)
                    ids.append(-1)
                    scores.append(0.0)
                at = nodes[at, c]
            if ids[at] < 0:
                ids[at], scores[at] = i, score
        self.ids, self.scores = np.array(ids, np.int64), np.array(scores)
        keys = np.array([n << 21 | c for n, c in nodes], np.int64)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.after = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.slots = np.searchsorted(slot[order], np.arange((1 << 20) + 1))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The prefixes with one more character; -1 where no piece begins so."""
        key = nodes << 21 | chars
        slot = self._slot(key)
        low, high = self.slots.take(slot), self.slots.take(slot + 1)
        out = np.full(len(key), -1, np.int64)
        left = np.flatnonzero(low < high)
        low, high, key = low[left], high[left], key[left]
        while len(left):
            found = self.keys.take(low) == key
            out[left[found]] = self.after.take(low[found])
            low = low + 1
            rest = np.flatnonzero(~found & (low < high))
            left, low, high, key = left[rest], low[rest], high[rest], key[rest]
        return out


@dataclass(frozen=True)
class Edges:
    """Edges of the lattices of many words laid end to end; positions are those in the line."""

    chars: np.ndarray
    starts: np.ndarray  # of words, and the end of the last
    word: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    id: np.ndarray
    score: np.ndarray


def _edges(words: list[str], prefixes: Prefixes) -> Edges:
    chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    starts = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
    word = np.repeat(np.arange(len(words)), np.diff(starts))
    stop = starts[1:][word]
    at, node, size = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
    found = []
    while len(at):
        node = prefixes.step(node, chars.take(at + size))
        size += 1
        on = np.flatnonzero(node >= 0)
        at, node = at.take(on), node.take(on)
        ends = np.flatnonzero(prefixes.ids.take(node) >= 0)
        found.append((at.take(ends), at.take(ends) + size, node.take(ends)))
        on = np.flatnonzero(at + size < stop.take(at))
        at, node = at.take(on), node.take(on)
    begin, end, node = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return Edges(chars, starts, word.take(begin), begin, end, prefixes.ids.take(node), prefixes.scores.take(node))


def _merged(edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Where symbols begin after merging, and their ids: always the edge of the highest score over two
    symbols of a word, leftmost first. Every word takes an edge a round."""
    n = len(edges.chars)
    bound, ids = np.ones(n + 1, bool), np.full(n, -1, np.int64)
    single = np.flatnonzero(edges.end - edges.begin == 1)
    ids[edges.begin[single]] = edges.id[single]
    order = np.flatnonzero(edges.end - edges.begin > 1)
    order = order[np.lexsort((-edges.end[order], edges.begin[order], -edges.score[order], edges.word[order]))]
    word, begin, end, piece = (x.take(order) for x in (edges.word, edges.begin, edges.end, edges.id))
    while len(word):
        before = np.cumsum(bound)
        symbols = before.take(end - 1) - before.take(begin) + 1
        # Boundaries never come back, so an edge without its own, or within one symbol, is over.
        on = np.flatnonzero(bound.take(begin) & bound.take(end) & (symbols > 1))
        word, begin, end, piece, symbols = (x.take(on) for x in (word, begin, end, piece, symbols))
        two = np.flatnonzero(symbols == 2)
        if not len(two):
            break
        best = two[np.r_[True, np.diff(word.take(two)) != 0]]
        ids[begin[best]] = piece[best]
        inner = end[best] - begin[best] - 1
        bound[np.repeat(begin[best] + 1 - (np.cumsum(inner) - inner), inner) + np.arange(inner.sum())] = False
    return bound[:n], ids


def _viterbi(edges: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of the paths with the highest sums of scores begin, and their ids.

    To each position the best of the edges that end there, or a character as bytes; ties go to
    the longest piece. The positions of a word are gone through in order, those of all words side by side.
    """
    n, words = len(edges.chars), len(edges.starts) - 1
    bound, ids = np.zeros(n, bool), np.full(n, -1, np.int64)
    sizes = np.diff(edges.starts)
    own = edges.starts[:-1] + np.arange(words)  # a word has a place more than characters
    cost, back, via = np.zeros(n + words), np.zeros(n + words, np.int64), np.full(n + words, -1, np.int64)
    place = edges.end - edges.starts[edges.word]
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(sizes.max(initial=0) + 2))
    for k in range(1, sizes.max(initial=0) + 1):
        alive = own[sizes >= k]
        some = order[cuts[k]:cuts[k + 1]]
        to = np.r_[alive + k, edges.end[some] + edges.word[some]]
        of = np.r_[alive + k - 1, edges.begin[some] + edges.word[some]]
        got = cost[of] + np.r_[np.full(len(alive), BYTE_SCORE), edges.score[some]]
        piece = np.r_[np.full(len(alive), -1), edges.id[some]]
        ranked = np.lexsort((of, -got, to))
        best = ranked[np.r_[True, np.diff(to[ranked]) != 0]]
        cost[to[best]], back[to[best]], via[to[best]] = got[best], of[best], piece[best]
    word, at = np.arange(words), own + sizes
    while len(word):
        on = np.flatnonzero(at > own[word])
        word, at = word[on], at[on]
        bound[back[at] - word], ids[back[at] - word] = True, via[at]
        at = back[at]
    return bound, ids


def fold(words: list[str], pieces: Pieces, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words end to end, and how many each has; a character without a piece gives its bytes' ids."""
    out, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in slices(words, SLICE):
        edges = _edges(words[a:b], prefixes)
        bound, ids = (_merged if pieces.merges else _viterbi)(edges)
        at = np.flatnonzero(bound)
        ids = ids[at]
        bare = np.flatnonzero(ids < 0)
        # A symbol without a piece is one character.
        raw = [[pieces.bytes_at[x] for x in chr(c).encode()] for c in edges.chars[at[bare]].tolist()]
        takes = np.ones(len(at), np.int64)
        takes[bare] = [len(x) for x in raw]
        spread = np.repeat(ids, takes)
        spread[np.repeat(ids < 0, takes)] = [x for some in raw for x in some]
        before = np.r_[0, np.cumsum(takes)]
        out.append(spread)
        counts.append(np.diff(before[np.searchsorted(at, edges.starts)]))
    return np.concatenate(out), np.concatenate(counts)


def word_ids(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``word, ids`` for different words (column ``word``), already dealt by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = Prefixes(pieces)
        for batch in batches:
            ids, counts = fold(batch.column(0).to_pylist(), pieces, prefixes)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def long_ids(word: str, pieces: Pieces, table: dict[str, tuple[int, float]]) -> list[int]:
    """Ids of one word of any length, as the folds find them; ``table`` has id and score by piece."""
    ends = (_heap_ends if pieces.merges else _path_ends)(word, pieces, table)
    out: list[int] = []
    begin = 0
    for end in ends:
        found = table.get(word[begin:end])
        out += [pieces.bytes_at[x] for x in word[begin:end].encode()] if found is None else [found[0]]
        begin = end
    return out


def _heap_ends(word: str, pieces: Pieces, table: dict[str, tuple[int, float]]) -> list[int]:
    """Where symbols end after merging by score, leftmost first; a merge renews its two neighbours."""
    n = len(word)
    end = list(range(1, n + 1))  # of the symbol that begins here; 0 if none does
    before = list(range(-1, n))
    heap: list[tuple[float, int, int, int]] = []

    def offer(left: int) -> None:
        middle = end[left]
        if left >= 0 and middle < n and end[middle] - left <= pieces.longest:
            found = table.get(word[left:end[middle]])
            if found is not None:
                heapq.heappush(heap, (-found[1], left, middle, end[middle]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, left, middle, stop = heapq.heappop(heap)
        if end[left] != middle or end[middle] != stop:
            continue  # one of the two has been merged since
        end[left], end[middle] = stop, 0
        before[stop] = left
        offer(left)
        if left:
            offer(before[left])
    out, at = [], 0
    while at < n:
        at = end[at]
        out.append(at)
    return out


def _path_ends(word: str, pieces: Pieces, table: dict[str, tuple[int, float]]) -> list[int]:
    """Where the pieces of the path with the highest sum of scores end; ties go to the longest piece."""
    cost, back = [0.0], [0]
    for end in range(1, len(word) + 1):
        best = (cost[end - 1] + BYTE_SCORE, 1 - end)
        for begin in range(max(0, end - pieces.longest), end):
            found = table.get(word[begin:end])
            if found is not None:
                best = max(best, (cost[begin] + found[1], -begin))
        cost.append(best[0])
        back.append(-best[1])
    out, at = [], len(word)
    while at:
        out.append(at)
        at = back[at]
    return out[::-1]


def _piece_table(model: str) -> tuple[Pieces, dict[str, tuple[int, float]]]:
    """A worker's pieces, for :func:`long_ids`."""

    def load() -> tuple[Pieces, dict[str, tuple[int, float]]]:
        pieces = Pieces.load(model)
        return pieces, {p: (i, s) for p, i, s in pieces.rows}

    return kept(("pieces", model), load)


def _prefixes(model: str) -> Prefixes:
    return kept(("prefixes", model), lambda: Prefixes(_piece_table(model)[0]))


def _neighbours(model: str) -> tuple[np.ndarray, np.ndarray]:
    """A class for each character that stands beside another in a piece (0: none), and which classes meet so."""

    def load() -> tuple[np.ndarray, np.ndarray]:
        pairs = {p[i:i + 2] for p, _, _ in _piece_table(model)[0].rows for i in range(len(p) - 1)}
        classes = np.zeros(0x110000, np.int32)
        for i, c in enumerate(sorted({c for pair in pairs for c in pair}), 1):
            classes[ord(c)] = i
        meet = np.zeros((classes.max() + 1,) * 2, bool)
        for x, y in pairs:
            meet[classes[ord(x)], classes[ord(y)]] = True
        return classes, meet

    return kept(("neighbours", model), load)


_KEPT = ("pieces", "prefixes", "neighbours")


def _parts(words: list[str], model: str) -> tuple[list[str], list[int]]:
    """Words cut where no piece leads over, end to end, and how many parts each has."""
    classes, meet = _neighbours(model)
    line = "".join(words)
    of = classes[np.frombuffer(line.encode("utf-32-le"), "<u4")]
    starts = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    new = np.ones(len(line) + 1, bool)
    new[1:-1] = ~meet[of[:-1], of[1:]]
    new[starts] = True
    at = np.flatnonzero(new)
    counts = np.diff(np.searchsorted(at, np.r_[0, starts]))
    return [line[a:b] for a, b in itertools.pairwise(at.tolist())], counts.tolist()


def _different(texts: list[str | None], model: str, buckets: int) -> tuple[list[str], list[str], list[int], list[list[str]]]:
    """The different words of texts, their parts end to end, how many parts each word has, and
    the different parts of at most ``SHORT`` characters in order, by bucket."""
    found: set[str] = set()
    for t in texts:
        found.update(cut(t or ""))
    words = list(found)
    parts, counts = _parts(words, model)
    dealt: list[list[str]] = [[] for _ in range(buckets)]
    for p in sorted(set(parts)):
        if len(p) <= SHORT:
            dealt[zlib.crc32(p.encode()) % buckets].append(p)
    return words, parts, counts, dealt


def _bundle(parts: list[str]) -> bytes:
    """Parts of at most 255 characters in little room: their lengths, then their text."""
    raw = bytes(map(len, parts)) + "".join(parts).encode()
    return struct.pack("<2I", len(parts), len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _opened(data: bytes) -> list[str]:
    n, size = struct.unpack_from("<2I", data)
    raw = pa.decompress(data[8:], size, "zstd", asbytes=True)
    line, ends = raw[n:].decode(), np.cumsum(np.frombuffer(raw, "u1", n), dtype=np.int64).tolist()
    return [line[a:b] for a, b in zip([0, *ends], ends)]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id column, ``n_tokens`` and ``ids`` (32-bit ids, little-endian).

    A null or empty text has none. Ids may be null or repeat. Documents are written once as a
    bucketed table of chunks (``lattice_<uuid>``); a chunk sends its different parts of words, a
    bundle for each bucket of the parts' hashes, and gets their ids back in the bundle's order, so
    texts are not shuffled and a frequent word is sent once a chunk.
    """
    spark = docs.sparkSession
    name = f"lattice_{uuid.uuid4().hex}"
    buckets = 4 * shuffle_width(spark)
    (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
     .withColumn("_chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS))
     .write.bucketBy(shuffle_width(spark), "_chunk").option("compression", "zstd")
     .option("path", shared_path(spark, "chunks")).saveAsTable(name))
    table = spark.table(name)

    def vocabulary(key: tuple, chunk: pa.Table) -> pa.Table:
        lean(*_KEPT)
        dealt = _different(chunk.column("_text").to_pylist(), model, buckets)[-1]
        sent = [(b, _bundle(parts)) for b, parts in enumerate(dealt) if parts]
        return pa.table([pa.array([key[0].as_py()] * len(sent), pa.int64()), pa.array([b for b, _ in sent], pa.int32()),
                         pa.array([x for _, x in sent], pa.binary())], ["_chunk", "bucket", "parts"])

    def answer(key: tuple, bundles: pa.Table) -> pa.Table:
        lean(*_KEPT)
        opened = [_opened(x) for x in bundles.column("parts").to_pylist()]
        words = pa.array(itertools.chain.from_iterable(opened), pa.string()).dictionary_encode()
        ids, counts = fold(words.dictionary.to_numpy(zero_copy_only=False).tolist(), _piece_table(model)[0], _prefixes(model))
        ends = np.r_[0, np.cumsum(counts)]
        index, out = words.indices.to_numpy(), []
        for a, b in itertools.pairwise([0, *itertools.accumulate(map(len, opened))]):
            n = counts[index[a:b]]
            shift = ends[index[a:b]] - (np.cumsum(n) - n)
            raw = n.astype("<u4").tobytes() + ids[np.repeat(shift, n) + np.arange(n.sum())].astype("<i4").tobytes()
            out.append(struct.pack("<2I", len(n), len(raw)) + pa.compress(raw, "zstd", asbytes=True))
        return pa.table([bundles.column("_chunk"), bundles.column("bucket"), pa.array(out, pa.binary())], ["_chunk", "bucket", "ids"])

    def put(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        lean(*_KEPT)
        texts = chunk.column("_text").to_pylist()
        words, parts, counts, dealt = _different(texts, model, buckets)
        of: dict[str, bytes] = {}
        for b, data in zip(answers.column("bucket").to_pylist(), answers.column("ids").to_pylist()):
            n, size = struct.unpack_from("<2I", data)
            raw = pa.decompress(data[8:], size, "zstd", asbytes=True)
            ends = (4 * n + 4 * np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64)).tolist()
            of.update(zip(dealt[b], [raw[x:y] for x, y in zip([4 * n, *ends], ends)]))
        made = [of[p] if len(p) <= SHORT else np.array(long_ids(p, *_piece_table(model)), "<i4").tobytes() for p in parts]
        at = iter(made)
        spelled = {w: next(at) if n == 1 else b"".join(itertools.islice(at, n)) for w, n in zip(words, counts)}
        whole = [b"".join([spelled[w] for w in cut(t)]) if t else b"" for t in texts]
        return pa.table([chunk.column("_id"), pa.array([len(m) // 4 for m in whole], pa.int64()), pa.array(whole, pa.binary())],
                        [id_col, "n_tokens", "ids"])

    sent = table.groupBy("_chunk").applyInArrow(vocabulary, "_chunk long, bucket int, parts binary")
    answers = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, "_chunk long, bucket int, ids binary")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    return table.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(put, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Add ``text``, what the ids of encoded documents spell; a column of that name is replaced.

    The text itself comes back, but for characters that are the blank's stand-in to begin with.
    """
    encoded = encoded.drop("text")
    texts = Pieces.load(model).texts
    byte_of = {p: int(p[1:-1], 16) for p in texts if len(p) == 6 and p.startswith("<0x") and p.endswith(">")}
    spelled = [bytes([byte_of[p]]) if p in byte_of else p.encode() for p in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            begin = 0
            for some in runs(batch.column(batch.schema.get_field_index("ids"))):
                out = []
                for data in some.to_pylist():
                    raw = b"".join([spelled[i] for i in np.frombuffer(data or b"", "<i4").tolist()])
                    out.append(raw.decode("utf-8", "replace").replace(BLANK, " ")[1:])
                own = batch.slice(begin, len(some))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out, pa.string())], [*batch.schema.names, "text"])
                begin += len(some)
            lean()

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))
