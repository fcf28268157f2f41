"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import itertools
import os
import re
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens.session import ensure_checkpoint_dir

# Fixed value: a word is a run of characters other than these.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

_WORDS = re.compile(WORD)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def landed(df: DataFrame, what: str = "table", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files."""
    path = shared_path(df.sparkSession, what)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"))


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in a Python process.

    Functions travel to workers by value, so a module's own variables don't outlive a task.
    """
    store = sys.__dict__.setdefault("_provlens_llm_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def _trimmer() -> Callable[[int], Any]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)  # glibc's


def lean(*kinds: str) -> None:
    """Forget what other steps keep in this worker, all but keys of these kinds, and give freed memory back.

    Spark uses a worker again for other steps and holds idle ones for a minute: without this, what
    one step kept or freed adds to the next one's share of the executor.
    """
    store = sys.__dict__.setdefault("_provlens_llm_kept", {})
    for key in [k for k in store if k[0] not in kinds and k[0] != "trimmer"]:
        del store[key]
    pa.default_memory_pool().release_unused()
    kept(("trimmer",), _trimmer)(0)


def runs(texts: pa.Array, limit: int = 1 << 20) -> Iterator[pa.Array]:
    """A column in runs of about ``limit`` bytes, a row at least: Python holds one run at a time."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield texts.slice(begin, end - begin)
        begin = end


_USUAL = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; kept for texts of usual length."""

    def make(size: int) -> np.ndarray:
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return make(n) if n > _USUAL else kept(("powers", base), lambda: make(_USUAL))[:n]


class Hasher:
    """Word and window hashes of many texts at once; ``seed`` gives independent families.

    Each byte counts with a random weight times a power of an odd base, so a word's
    hash is a difference of running sums; windows combine scrambled word hashes the
    same way.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        odd = lambda: int(rng.integers(1, 1 << 62)) * 8 + 5
        self.base, self.step = odd() & (2**64 - 1), odd() & (2**64 - 1)
        self.weights = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.inverse = pow(self.base, -1, 1 << 64)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ``data[starts:ends]`` (bytes)."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.weights[data] * _powers(self.base, len(data)), out=total[1:])
        back = _powers(self.inverse, len(data) + 1)
        return mix((total[ends] - total[starts]) * back[starts]
                   + (ends - starts).astype(np.uint64) * _ODD)

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hashes of every run of ``size`` items; one less than ``size`` at the end are left out."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out *= np.uint64(self.step)
            out += hashes[k:k + n]
        return mix(out)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end as bytes, word starts and ends in them, and the first word of each text.

    The last array has one entry more than there are texts.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begins[1:])
    return data, starts, ends, np.searchsorted(starts, begins)


def slices(texts: list[str | None], limit: int = 250_000) -> list[tuple[int, int]]:
    """Cut a list of texts into runs of about ``limit`` characters, a text at least."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            out.append((begin, i))
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out


class Encoder:
    """Token ids of texts by a tokenizers file; words met before are not encoded again.

    The tokenizer splits at white space and between letters and marks before anything
    else, so a text's ids are its words' ids put end to end, and "Word." has the ids of
    "word" and ".". ``keep`` bounds the words that are kept, ``keep_stems`` the lower-case
    stems (as many if None).
    """

    MARKS = ".,;:!?#$%&*"

    def __init__(self, path: str, keep: int = 1 << 18, keep_stems: int | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        # Splitting off marks and case is right for tokenizers that do so themselves only.
        marks = self.MARKS
        self.stems = all(self._plain(a + b) == self._plain(a.lower()) + self._plain(b)
                         for a, b in (("Word", "."), ("Ab", "!"), ("été", ","), ("Été", marks), ("x", marks[::-1])))
        self.last = self._last_ids()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.keep, self.keep_stems = keep, keep if keep_stems is None else keep_stems

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _last_ids(self) -> np.ndarray | None:
        """Whether an id ends a run of letters, for tokenizers that mark the ends and split at blanks."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not self.stems or not suffix or self._plain("ab Cd é") != [*self._plain("ab"), *self._plain("cd"), *self._plain("é")]:
            return None
        vocab = self.tokenizer.get_vocab()
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
        return last

    def _split(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Lower-case stems of letters and the marks after them; of other words the word itself and nothing."""
        if not self.stems:
            return words, [""] * len(words)
        stems = [w.rstrip(self.MARKS) for w in words]
        lower = "\n".join(stems).lower().split("\n")
        # Capital sigma lowers by context.
        right = [s.isalpha() and "\u03a3" not in s for s in stems]
        return ([low if ok else w for low, ok, w in zip(lower, right, words)],
                [w[len(s):] if ok else "" for s, ok, w in zip(stems, right, words)])

    def _made(self, parts: list[str]) -> list[bytes]:
        """Ids of each part; many that are letters only are put into one text and told apart by their last ids."""
        out: list[bytes] = [b""] * len(parts)
        rest = list(range(len(parts)))
        if self.last is not None:
            runs, rest = [i for i in rest if parts[i].isalpha()], [i for i in rest if not parts[i].isalpha()]
            lists = [runs[a:a + 500] for a in range(0, len(runs), 500)]
            texts = [" ".join([parts[i] for i in some]) for some in lists]
            for some, made in zip(lists, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(made.ids, self.kind)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(some) or ends[-1] != len(ids):
                    rest += some  # some part is more than one run of letters to this tokenizer
                    continue
                data, at = ids.tobytes(), 0
                for i, end in zip(some, (ends * self.kind.itemsize).tolist()):
                    out[i], at = data[at:end], end
        made = self.tokenizer.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)
        for i, x in zip(rest, made):
            out[i] = np.array(x.ids, self.kind).tobytes()
        return out

    def _learn(self, found: list[str]) -> list[bytes]:
        first, marks = self._split(found)
        got = list(map(self.parts.get, first))
        tails = {m: self.parts.get(m) for m in set(marks)}
        fresh = list({p: None for parts in (zip(first, got), tails.items()) for p, x in parts if x is None})
        new = dict(zip(fresh, self._made(fresh)))
        tails = {m: new[m] if x is None else x for m, x in tails.items()}
        out = [new[p] if x is None else x for p, x in zip(first, got)]
        out = [i + tails[m] if m else i for i, m in zip(out, marks)]
        for store, more, keep in ((self.parts, new.items(), self.keep_stems), (self.words, zip(found, out), self.keep)):
            if len(store) < keep:
                store.update([x for x in more if len(x[0]) <= 64][:keep - len(store)])
        return out

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and where each text's begin, with one entry more; null has none.

        Different words are looked up once, their ids put in the words' places.
        """
        # Split at ASCII white space only.
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        found = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.words.get, found))
        fresh = [i for i, x in enumerate(got) if x is None]
        for i, x in zip(fresh, self._learn([found[i] for i in fresh]) if fresh else ()):
            got[i] = x
        data = np.frombuffer(b"".join(got), self.kind)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // self.kind.itemsize
        index = words.indices.to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(sizes[index])]
        shift = (np.cumsum(sizes) - sizes)[index] - ends[:-1]
        ids = data[np.repeat(shift, sizes[index]) + np.arange(ends[-1])]
        begins = lists.offsets.to_numpy()
        return ids, ends[begins - begins[0]]

    def each(self, texts: pa.Array, limit: int = 1 << 20) -> Iterator[np.ndarray]:
        """Ids of each text, in order; about ``limit`` bytes of text are looked at together."""
        for some in runs(texts, limit):
            ids, at = self.many(some)
            for a, b in itertools.pairwise(at.tolist()):
                yield ids[a:b]
        lean("encoder")

    def ids(self, text: str | None) -> np.ndarray:
        # Lone surrogates are not text.
        return self.many(pa.array([(text or "").encode("utf-8", "replace").decode()], pa.string()))[0]


def encoder(path: str, keep_stems: int | None = None) -> Encoder:
    """This worker's encoder for a file."""
    return kept(("encoder", path, keep_stems), lambda: Encoder(path, keep_stems=keep_stems))


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
