"""Operator 4: language identification by bit-sliced Bloom filters of letter n-grams.

One filter serves all languages: a slot holds a bit per language, an n-gram's slots are
ANDed, and one lookup gives every language that contains it. A text's n-grams are counted
per language, the counts are corrected for each language's rate of false positives, and
the highest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens.llm.common import kept, lean, mix, runs, slices

ORDERS = (2, 4)  # letters in an n-gram; a word's ends count as one blank each
SLOTS = 1 << 21  # of the filter, 8 bytes each
PROBES = 3
PER_LANGUAGE = 4000  # labelled documents, about, that a language is learned from
SHARE = 0.25  # an n-gram belongs to a language where its rate is this part of its highest rate
LEAST = 3  # times an n-gram occurs in a language's sample
MOST_LANGUAGES = 64  # bits of a slot
UNKNOWN = "und"
LEAST_SCORE = 0.3  # below it a document is in no language for sure
_SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str | None], orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of texts, the text of each, and the number of letters of each text.

    Letters are lower case; each run of others counts as one blank; n-grams with a blank
    inside are left out, and ``orders`` are 2 or more.
    """
    alpha = kept(("letters",), _letters)
    lowered = ["" if t is None else t.lower() for t in texts]
    data = np.frombuffer("\n\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 2 for t in lowered], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    owner = np.r_[owner, np.full(len(data) - len(owner), max(len(texts) - 1, 0))]
    letter = alpha[np.minimum(data, 0x10FFFF)]
    counts = np.bincount(owner[letter], minlength=len(texts))
    use = letter.copy()
    use[1:] |= letter[:-1]  # a blank after a run
    use[0] = True  # and one before the first
    codes = np.where(letter, data, 32)[use].astype(np.uint64)
    blank, owner = codes == 32, owner[use]
    out, whose = [], []
    scrambled = mix(codes + np.uint64(1))
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        inside = np.zeros(m, bool)
        for k in range(n):
            h = h * np.uint64(0x5851F42D4C957F2D) + scrambled[k:k + m]
            if 0 < k < n - 1:
                inside |= blank[k:k + m]
        # A blank before a word may belong to the text before: an n-gram goes with its last letter.
        out.append(mix(h[~inside]))
        whose.append(np.where(blank[n - 1:], owner[n - 2:n - 2 + m], owner[n - 1:])[~inside])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    return np.concatenate(out), np.concatenate(whose), counts


def slots_of(hashes: np.ndarray, slots: int, probe: int) -> np.ndarray:
    return (mix(hashes ^ np.uint64(_SEEDS[probe])) % np.uint64(slots)).astype(np.int64)


@dataclass
class Model:
    """The filter (a mask per slot), its languages and each one's rate of false positives."""

    languages: list[str]
    masks: np.ndarray
    rates: np.ndarray
    orders: tuple[int, ...] = ORDERS

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of all languages that contain it."""
        mask = self.masks[slots_of(hashes, len(self.masks), 0)]
        for p in range(1, PROBES):
            mask = mask & self.masks[slots_of(hashes, len(self.masks), p)]
        return mask

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the score is the winner's corrected share of n-grams.

        Ties go to the language that comes first by name.
        """
        hashes, whose, letters = ngrams(texts, self.orders)
        mask = self.containing(hashes)
        total = np.bincount(whose, minlength=len(texts)).astype(float)
        shares = np.zeros((len(self.languages), len(texts)))
        for i in range(len(self.languages)):
            has = (mask >> np.uint64(i)) & np.uint64(1)
            hits = np.bincount(whose, weights=has.astype(float), minlength=len(texts))
            # hits = true + rate * (total - true)
            shares[i] = (hits - self.rates[i] * total) / np.maximum((1 - self.rates[i]) * total, 1e-9)
        shares = np.clip(shares, 0, 1)
        best = shares.argmax(axis=0)
        top = shares.max(axis=0)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, letters)]
        return names, [float(s) if n else 0.0 for s, n in zip(top, letters)]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE,
          slots: int = SLOTS, seed: int = 4) -> Model:
    """Learn a filter from labelled documents; null texts and labels are left out.

    About ``per_language`` documents of each language are drawn, which bounds what is
    shuffled and the filter's load. An n-gram enters the languages where it is about as
    frequent as anywhere, so a few wrong labels do no harm. The filter itself has a fixed
    size; it alone comes to the driver, and is sent to every task.
    """
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()) \
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros(slots, np.uint64), np.zeros(0))
    drawn = rows.sampleBy("lang", {k: min(1.0, per_language / n) for k, n in sizes.items()}, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lean("letters")
            langs, texts = (c.to_pylist() for c in batch.columns)
            number = {k: i for i, k in enumerate(dict.fromkeys(langs))}
            names = list(number)
            code = np.array([number[x] for x in langs], np.int64)
            for a, b in slices(texts):
                hashes, whose, _ = ngrams(texts[a:b])
                for i in np.unique(code[a:b]):
                    h, n = np.unique(hashes[code[a:b][whose] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i]] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())],
                        ["lang", "gram", "n"])

    grams = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rate = F.lit(0.0)
    for k, n in totals.items():
        rate = F.when(F.col("lang") == k, F.col("n") / n).otherwise(rate)
    bit = F.lit(0).cast("long")
    for i, k in enumerate(languages):
        bit = F.when(F.col("lang") == k, F.lit(int(np.uint64(1 << i).view(np.int64))).cast("long")).otherwise(bit)
    by_gram = grams.withColumn("rate", rate).groupBy("gram").agg(
        F.max("rate").alias("top"), F.collect_list(F.struct(bit.alias("bit"), "rate", "n")).alias("all"))
    member = F.aggregate(
        F.filter("all", lambda x: (x["rate"] >= SHARE * F.col("top")) & (x["n"] >= LEAST)), F.lit(0).cast("long"),
        lambda m, x: m.bitwiseOR(x["bit"]))
    members = by_gram.select("gram", member.alias("mask")).filter("mask <> 0")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch.column(0).to_numpy().view(np.uint64)
            mask = batch.column(1).to_numpy()
            for p in range(PROBES):
                yield pa.RecordBatch.from_arrays([pa.array(slots_of(gram, slots, p)), pa.array(mask)], ["slot", "mask"])

    filled = members.mapInArrow(place, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(slots, np.uint64)
    masks[filled.column("slot").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    load = np.array([((masks >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, masks, load ** PROBES)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``lang_score``; columns of these names are replaced.

    Whole texts are looked at. A null text, one without a letter, and any text under a model
    that has learned nothing is ``und`` with score 0.
    """
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "lang_score")
    # Of fixed size, whatever the data; plain arrays, as workers may not have this package.
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks, model.rates, model.orders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean("letters")
        here = Model(*sent.value)
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for some in runs(batch.column(batch.schema.get_field_index(text))):
                texts = some.to_pylist()
                for a, b in slices(texts):
                    got = here.predict(texts[a:b]) if here.languages else ([UNKNOWN] * (b - a), [0.0] * (b - a))
                    names += got[0]
                    scores += got[1]
            lean("letters")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*batch.schema.names, "lang_pred", "lang_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, and predict all: doc_id, held_out, lang_pred, score."""
    model = learn(docs.filter(~held_out()))
    chosen = docs.select("doc_id", "text")
    return (identify(chosen, model)
            .select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score")))


def in_known_language(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents that are in a learned language by a score of ``least`` or more, columns unchanged."""
    columns = docs.columns
    found = identify(docs, learn(docs.filter(~held_out())))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least)) \
        .select(*[F.col(f"`{c}`") for c in columns])
