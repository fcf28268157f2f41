"""Operator 11: toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over the terms that go with the label; the rest of a text counts as one
more term, so that a few such terms in a long text weigh less. Labelled examples lie in an
inverted index whose postings come in blocks with their highest weight. A text's nearest
examples by cosine are found exactly: blocks are taken by upper bound until none can hold a
nearer one. Their votes, weighted by distance, are calibrated by leaving each example out once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlens.llm.common import landed
from provlens.llm.language import held_out
from provlens.llm.lexical import BATCH_DOCS, batches_of

PER_LABEL = 4000  # labelled documents of each label, at most, that are learned from
TERMS = 1024  # in the vocabulary, at most
STEM = 5  # letters of a word's beginning that are a term too
LEAST_LINK = 15.0  # log-likelihood ratio of a term and the label
LEAST_LIFT = 3.0  # times that a term is likelier in toxic examples than in clean ones
LEAST_SEEN = 3  # toxic examples that have the term
REST = 1.0  # weight of all other words of a text
NEAREST = 15
NEAR = 0.05  # added to distances, so that an equal example has no endless weight
BLOCK = 64  # entries
TOXIC_SCORE = 0.7
EVIDENCE = 3  # of the nearest examples that are returned

_LETTERS = r"[^\W\d_]+"


def term_counts(text: str | None) -> tuple[Counter, int]:
    """Words of a text in small letters and the beginnings of longer ones, and the number of words."""
    words = Counter(re.findall(_LETTERS, text.lower())) if text else Counter()
    terms = Counter(words)
    for w, n in words.items():
        if len(w) > STEM:
            terms[w[:STEM] + "*"] += n
    return terms, sum(words.values())


def known_terms(text: str | None, vocabulary: dict[str, int]) -> tuple[dict[int, int], int]:
    """Counts of a text's vocabulary terms by number, and the number of words."""
    words = Counter(re.findall(_LETTERS, text.lower())) if text else Counter()
    found: dict[int, int] = {}
    for w, n in words.items():
        t = vocabulary.get(w)
        if t is not None:
            found[t] = found.get(t, 0) + n
        if len(w) > STEM:
            t = vocabulary.get(w[:STEM] + "*")
            if t is not None:
                found[t] = found.get(t, 0) + n
    return found, sum(words.values())


def vector(found: dict[int, int], words: int, idf: np.ndarray) -> tuple[tuple[int, ...], np.ndarray]:
    """A unit vector as term numbers and weights; the last number is the rest of the text."""
    terms = sorted(found)
    weights = np.array([(1 + np.log(found[t])) * idf[t] for t in terms] + [REST * (1 + np.log(max(1, words)))])
    return (*terms, len(idf)), weights / np.sqrt((weights * weights).sum())


@dataclass
class Index:
    """Block-max inverted index of labelled examples; equal vectors share an entry.

    Postings of all terms lie end to end. ``begins[t, b]`` is where those of term ``t`` in
    block ``b`` begin, and ``highest[t, b]`` the greatest weight among them.
    """

    entries: np.ndarray
    weights: np.ndarray
    begins: np.ndarray
    highest: np.ndarray
    examples: np.ndarray  # of each entry
    toxic: np.ndarray  # weight of toxic ones
    total: np.ndarray  # weight of all
    names: list[int]  # an example of each entry

    def _cosines(self, rows: list[int], weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of some blocks (a flag for each) and their cosines."""
        sums = np.zeros(len(self.examples))
        for t, w in zip(rows, weights):
            span = slice(self.begins[t, 0], self.begins[t, -1])
            entries = self.entries[span]
            chosen = blocks[entries // BLOCK]
            sums[entries[chosen]] += w * self.weights[span][chosen]
        here = np.flatnonzero(np.repeat(blocks, BLOCK)[:len(sums)])
        return here, sums[here]

    def nearest(self, terms: tuple[int, ...], weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Entries with the ``k`` nearest examples, and all as near as the last; their cosines.

        The blocks of highest bound give ``k`` examples; only blocks whose bound reaches the last
        of these can hold nearer ones. ``without`` takes one example out of an entry.
        """
        rows = list(terms)
        bounds = weights @ self.highest[rows]
        order = np.argsort(-bounds, kind="stable")
        examples = self.examples
        if without is not None:
            examples = examples.copy()
            examples[without] -= 1
        first = 2
        while True:
            blocks = np.zeros(len(bounds), bool)
            blocks[order[:first]] = True
            entries, cosines = self._cosines(rows, weights, blocks)
            down = np.argsort(-cosines, kind="stable")
            reach = np.searchsorted(np.cumsum(examples[entries[down]]), k)
            if reach < len(down) or first >= len(order):
                least = cosines[down[min(reach, len(down) - 1)]]
                break
            first *= 4
        more = bounds >= least - 1e-9
        if (more & ~blocks).any():
            entries, cosines = self._cosines(rows, weights, more)
            down = np.argsort(-cosines, kind="stable")
            reach = np.searchsorted(np.cumsum(examples[entries[down]]), k)
            least = cosines[down[min(reach, len(down) - 1)]]
        near = (cosines >= least - 1e-9) & (examples[entries] > 0)
        order = np.lexsort((entries[near], -cosines[near]))
        return entries[near][order], np.minimum(cosines[near][order], 1.0)

    def vote(self, entries: np.ndarray, cosines: np.ndarray, without: int | None = None, own: tuple[float, float] = (0.0, 0.0)) -> float:
        """The share of toxic ones among examples, each with its label's weight over its distance."""
        toxic, total = self.toxic[entries].copy(), self.total[entries].copy()
        if without is not None:
            toxic[entries == without] -= own[0]
            total[entries == without] -= own[1]
        pull = 1.0 / (NEAR + 1.0 - cosines)
        whole = float((pull * total).sum())
        return float((pull * toxic).sum()) / whole if whole > 1e-12 else 0.0


def index_of(vectors: list[tuple[tuple[int, ...], np.ndarray]], labels: list[int], ids: list[int], idf: np.ndarray,
             label_weights: tuple[float, float]) -> tuple[Index, list[int]]:
    """The index of examples, and each example's entry. Entries lie by their heaviest terms, so blocks are alike."""
    keys = [(int(t[int(np.argmax(w))]), t, np.round(w, 12).tobytes()) for t, w in vectors]
    order = sorted(range(len(keys)), key=lambda i: (keys[i], ids[i]))
    entry_of, firsts = [0] * len(keys), []
    for i in order:
        if not firsts or keys[firsts[-1]] != keys[i]:
            firsts.append(i)
        entry_of[i] = len(firsts) - 1
    examples = np.bincount(entry_of, minlength=len(firsts))
    worth = np.array([label_weights[y] for y in labels])
    total = np.bincount(entry_of, weights=worth, minlength=len(firsts))
    toxic = np.bincount(entry_of, weights=worth * np.array(labels), minlength=len(firsts))
    width = len(idf) + 1
    blocks = -(-len(firsts) // BLOCK)
    triples = sorted((t, e, w) for e, i in enumerate(firsts) for t, w in zip(vectors[i][0], vectors[i][1].tolist()))
    terms, entries, weights = (np.array(c) for c in zip(*triples))
    slot = terms.astype(np.int64) * blocks + entries // BLOCK
    highest = np.zeros(width * blocks)
    np.maximum.at(highest, slot, weights)
    cuts = np.searchsorted(slot, np.arange(width * blocks + 1))
    begins = np.c_[cuts[:-1].reshape(width, blocks), cuts[blocks::blocks]]
    return Index(entries, weights, begins, highest.reshape(width, blocks), examples, toxic, total,
                 [ids[i] for i in firsts]), entry_of


def calibration(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve from votes to the share of toxic examples (isotonic regression), by its corners."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # votes' sum, toxic weight, weight
    for v in np.unique(votes[order]):
        at = votes == v
        pools.append([float(v * weights[at].sum()), float((weights * labels)[at].sum()), float(weights[at].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    x = np.array([p[0] / p[2] for p in pools])
    y = np.array([p[1] / p[2] for p in pools])
    return x, y


@dataclass
class Model:
    """Vocabulary, weights, the index and the curve; all of bounded size."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    index: Index | None
    curve: tuple[np.ndarray, np.ndarray]

    def score(self, text: str | None, seen: dict) -> tuple[float, list[tuple[int, float, float]]]:
        """Score and evidence (example, cosine, toxic share of examples equal to it)."""
        if self.index is None:
            return 0.0, []
        terms, weights = vector(*known_terms(text, self.vocabulary), self.idf)
        key = (terms, weights.tobytes())
        if key not in seen:
            entries, cosines = self.index.nearest(terms, weights, NEAREST)
            vote = self.index.vote(entries, cosines)
            seen[key] = (float(np.clip(np.interp(vote, *self.curve), 0.0, 1.0)),
                         [(self.index.names[e], float(c), float(self.index.toxic[e] / self.index.total[e]))
                          for e, c in zip(entries[:EVIDENCE].tolist(), cosines)])
        return seen[key]


def _sampled(docs: DataFrame, labels: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """Texts of at most ``PER_LABEL`` documents a label, and how many documents have each label."""
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_LABEL) for y in (0, 1)]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most twice PER_LABEL rows
    texts = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return texts, sizes


def _linked(toxic: Column, clean: Column, toxics: int, cleans: int) -> Column:
    """Log-likelihood ratio of a term and the label, zero where it is not far likelier in toxic texts.

    Common words of a language that has more toxic texts than others are no sign of one.
    """
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    share = toxics / (toxics + cleans)
    both = toxic + clean
    rest = F.lit(toxics + cleans) - both
    value = 2 * (cell(toxic, both * share) + cell(clean, both * (1 - share))
                 + cell(toxics - toxic, rest * share) + cell(cleans - clean, rest * (1 - share)))
    return F.when(toxic * cleans > LEAST_LIFT * clean * toxics, value).otherwise(0.0)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learn from labelled documents that are not held out.

    A document with several labels has the one of most of its rows, toxic on a tie; of rows with
    one id the least text counts. Examples are a bounded sample; document counts of the
    vocabulary are over all documents. What comes to the driver is the sample's vectors over the
    vocabulary. Without labels, or with a single one, all is as the labels say.
    """
    spark = docs.sparkSession
    texts, sizes = _sampled(docs, labels, label)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, toxic, text = (c.to_pylist() for c in batch.columns)
            found = [term_counts(x) for x in text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array([n for _, n in found], pa.int64()),
                 pa.array([list(c) for c, _ in found], pa.list_(pa.string())),
                 pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int64()))], ["doc_id", "toxic", "words", "terms", "counts"])

    with batches_of(spark, BATCH_DOCS):
        examples = landed(texts.select("doc_id", "toxic", "text").mapInArrow(
            split, "doc_id long, toxic int, words long, terms array<string>, counts array<long>"), "examples")
        drawn = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
        if not drawn:
            return Model({}, np.zeros(0), None, (np.zeros(1), np.zeros(1)))
        seen = (examples.select("toxic", F.explode("terms").alias("term")).groupBy("term")
                .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
        linked = _linked(F.col("t"), F.col("c"), drawn.get(1, 0), drawn.get(0, 0))
        chosen = (seen.filter(F.col("t") >= LEAST_SEEN).select("term", linked.alias("link")).filter(F.col("link") >= LEAST_LINK)
                  .orderBy(F.desc("link"), "term").limit(TERMS).collect())
        vocabulary = {r["term"]: i for i, r in enumerate(chosen)}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(vocabulary) + 1, np.int64)
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    total[-1] += 1
                    for t in known_terms(x, vocabulary)[0]:
                        total[t] += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])

        held = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(count, "term long, n long")
                .groupBy("term").agg(F.sum("n").alias("n")).collect()}
        documents = held.get(len(vocabulary), 0)
        idf = np.array([np.log((1 + documents) / (1 + held.get(t, 0))) for t in range(len(vocabulary))])

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [[(vocabulary[t], n) for t, n in zip(terms, counts) if t in vocabulary]
                         for terms, counts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([[t for t, _ in x] for x in found], pa.list_(pa.int64())),
                                                  pa.array([[n for _, n in x] for x in found], pa.list_(pa.int64()))],
                                                 ["doc_id", "toxic", "words", "terms", "counts"])

        # Only terms of the vocabulary leave the tasks.
        rows = examples.mapInArrow(known, "doc_id long, toxic int, words long, terms array<long>, counts array<long>").orderBy("doc_id").collect()
        vectors = [vector(dict(zip(r["terms"], r["counts"])), r["words"], idf) for r in rows]
        toxic = [r["toxic"] for r in rows]
        label_weights = tuple(sizes.get(y, 0) / max(1, drawn.get(y, 0)) for y in (0, 1))
        index, entry_of = index_of(vectors, toxic, [r["doc_id"] for r in rows], idf, label_weights)
        # Bounded by PER_LABEL and TERMS; plain, as workers may not have this package.
        sent = spark.sparkContext.broadcast((vars(index), vectors, toxic, entry_of))

        def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, all_vectors, labels_of, entries_of = sent.value
            here = Index(**parts)
            for batch in batches:
                at = batch.column(0).to_pylist()
                votes = []
                for i in at:
                    worth = label_weights[labels_of[i]]
                    near = here.nearest(*all_vectors[i], NEAREST, entries_of[i])
                    votes.append(here.vote(*near, entries_of[i], (worth * labels_of[i], worth)))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(votes, pa.float64())], ["i", "vote"])

        votes = np.zeros(len(rows))
        for r in spark.range(len(rows)).mapInArrow(leave_out, "i long, vote double").collect():
            votes[r["i"]] = r["vote"]
    worth = np.array([label_weights[y] for y in toxic])
    return Model(vocabulary, idf, index, calibration(votes, np.array(toxic, float), worth))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text: doc_id, score, evidence.

    Null and empty texts, and texts without any term of the vocabulary, are scored by the
    examples that have none either. A model without examples scores all 0. Repeated rows get
    equal scores; other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.idf, model.index and vars(model.index), model.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, index, curve = sent.value
        here, seen = Model(vocabulary, idf, index and Index(**index), curve), {}
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())]))
        for batch in batches:
            if len(seen) > 1 << 14:
                seen.clear()
            found = [here.score(x, seen) for x in batch.column(1).to_pylist()]
            evidence = [[{"doc_id": d, "cosine": c, "toxic": s} for d, c, s in e] for _, e in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, kind)],
                                             ["doc_id", "score", "evidence"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("evidence", T.ArrayType(T.StructType([
                               T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()),
                               T.StructField("toxic", T.DoubleType())])))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and score all: doc_id, held_out, score, predicted, evidence."""
    return scored(docs, learn(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"), "evidence")
