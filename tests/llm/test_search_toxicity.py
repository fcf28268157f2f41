"""Ranked search and toxicity against brute force."""

import math
import random
import re
from collections import Counter
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest

from provlens.llm import lexical, toxicity

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall(text.translate(SMALL)) if text else []


def plain_ranking(docs, items, top):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if t in df}
        found = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // length
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(documents):
    texts = [documents[3][1][:200], documents[20][1][50:180], "WA wé Été joined", None, "", "?!", "nowhere-to-be-found",
             "x" * 50000 + " spam", documents[86][1], "i İ ß ÄB cd", "spam spam spam\nwords"]
    return [(i, t) for i, t in enumerate(texts)] + [(0, "spam"), (None, "two words")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id long, text string, rank int, ids string").repartition(2)


@pytest.mark.parametrize("top, budget", [(50, 1 << 16), (3, 40)])
def test_ranking_equals_brute_force(spark, docs, documents, items, monkeypatch, top, budget):
    monkeypatch.setattr(lexical, "QUERY_TERMS", budget)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    rows = lexical.search(lexical.build_index(docs), frame(spark, items), top=top).collect()
    wanted = plain_ranking(documents, items, top)
    # Copies of equal score and id may stand in any order.
    assert sorted(map(tuple, rows), key=str) == wanted


def test_bounds_are_never_below_scores():
    rng = random.Random(4)
    texts = [" ".join(f"t{min(int(rng.expovariate(0.05)), 300)}" for _ in range(rng.choice([5, 60, 4000]))).encode() for _ in range(40)]
    hashes, counts, begins = lexical.term_counts(texts)
    block = lexical.Block(9)
    for i, (a, b) in enumerate(zip(begins, begins[1:])):
        block.add((i, int(counts[a:b].sum()), int(counts[a:b].max()), hashes[a:b], counts[a:b], texts[i]))
    ids, lengths, highest, c, slices, _ = block.row()
    names = {f"t{i}".encode(): i for i in range(301)}
    q = lexical.Items([0, 1], [0, 1], names, [np.arange(301), np.arange(0, 301, 7)], 40, sum(lengths), np.arange(301) * 10)
    data, starts, ends, _ = lexical.joined([b" ".join(names).decode()])
    h = lexical.Hasher(12).spans(data, starts, ends)
    size = lexical.filter_size(c)
    slots = [[lexical.slots_of(h, j, p, size) for p in range(lexical.PROBES)] for j in range(len(lexical.LEVELS))]
    scale = q.scale(np.array(lengths))
    bounds = lexical.upper_bounds(q, slots, np.frombuffer(slices, np.uint8).reshape(size, -1), np.array(highest), scale)
    near = 0
    for d, t in enumerate(texts):
        has = Counter(t.split())
        for i, members in enumerate(q.members):
            score = sum(int(q.weights[m]) * lexical.part(has[f"t{m}".encode()], int(scale[d])) for m in members if f"t{m}".encode() in has)
            assert bounds[i, d] >= score
            near += bounds[i, d] <= 1.25 * score
    assert near > 60  # and mostly not far above


def test_index_is_read_a_few_blocks_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4)
    texts = spark.createDataFrame([(i, f"some words and w{i}") for i in range(200)], "doc_id long, text string").coalesce(1)
    index = lexical.build_index(texts)
    groups = [m.row_group(g).num_rows for m in (pq.read_metadata(unquote(urlparse(f).path)) for f in index.inputFiles())
              for g in range(m.num_row_groups)]
    assert sum(groups) == 50 and max(groups) <= lexical.BATCH_BLOCKS


def test_items_of_the_same_few_terms_go_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_TERMS", 40)
    monkeypatch.setattr(lexical, "QUERY_ITEMS", 5, raising=False)
    rows = spark.createDataFrame([(i, " ".join("abcdef"[:1 + 5 * (i // 16)])) for i in range(32)], "item_id long, text string").coalesce(1)
    groups = list(lexical._grouped(rows, "item_id", "text"))
    assert sorted(i for g in groups for i in g.ids) == list(range(32))
    assert max(len(g.ids) for g in groups) == 5 and max(sum(map(len, g.members)) for g in groups) <= 40


def test_nothing_to_search(spark, docs, nothing, items):
    assert lexical.best_documents(nothing, frame(spark, items)).collect() == []
    assert lexical.best_documents(docs, frame(spark, items).limit(0)).collect() == []


def toxic_rows(n=600):
    rng = random.Random(9)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rude = ["grumbleX", "snarlY", "Hissing", "hissed"]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(2, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad) if rng.random() < 0.99 else None))
    rows += [(n, None), (n + 1, ""), (n + 2, "1 2 3 !"), (None, "snarlY snarlY"), (5, rows[5][1]), (n + 3, "long " * 30000 + "snarlY"), (n + 4, "hissing " * 30000)]
    labels += [(None, 1), (7, 0), (8, 1), (8, 0), (99999, 1), (3, 5)]
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, toxic string, score double").repartition(3)
    return rows, docs, spark.createDataFrame([(d, y, 1) for d, y in labels], "doc_id long, toxic int, quality int")


def test_toxicity_finds_held_out_texts(toxic):
    rows, docs, labels = toxic
    out = toxicity.predictions(docs, labels).collect()
    assert len(out) == len(rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in out if r.held_out and truth.get(r.doc_id) in (0, 1)]
    assert len(held) > 100
    wrong = [r.doc_id for r in held if r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 0.03 * len(held), wrong
    by = {r.doc_id: r for r in out}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert len({by[i].score for i in (600, 601, 602)}) == 1 and by[600].predicted == 0
    assert by[604].predicted == 1 and by[None].predicted == 1 and not by[None].held_out
    near = by[604].evidence[0]
    assert len(by[604].evidence) == 3 and near.toxic > 0.5 and near.cosine > 0.5


def test_nearest_equals_all_cosines(toxic):
    rows, _, _ = toxic
    rng = np.random.default_rng(1)
    texts = [t for _, t in rows[:400]]
    vocabulary = {t: i for i, t in enumerate(["grumblex", "snarly", "hissing", "hissed", "hissi*", "grumb*", "ab", "ba", "cad"])}
    idf = rng.random(len(vocabulary)) * 3 + 0.5
    vectors = [toxicity.vector(*toxicity.known_terms(t, vocabulary), idf) for t in texts]
    labels = [int(x) for x in rng.integers(0, 2, len(texts))]
    index, entry_of = toxicity.index_of(vectors, labels, list(range(len(texts))), idf, (2.0, 1.0))
    dense = np.zeros((len(texts), len(idf) + 1))
    for i, (t, w) in enumerate(vectors):
        dense[i, list(t)] = w
    for i in range(0, len(texts), 3):
        cosines = dense @ dense[i]
        for without in (None, i):
            use = np.arange(len(texts)) != (-1 if without is None else i)
            least = np.sort(cosines[use])[::-1][toxicity.NEAREST - 1]
            near = use & (cosines >= least - 1e-9)
            entries, sims = index.nearest(*vectors[i], toxicity.NEAREST, None if without is None else entry_of[i])
            assert set(entries) == {entry_of[j] for j in np.flatnonzero(near)}
            pull = np.array([2.0 if y == 0 else 1.0 for y in labels]) / (toxicity.NEAR + 1 - np.minimum(cosines, 1))
            share = (pull * labels)[near].sum() / pull[near].sum()
            worth = 2.0 if labels[i] == 0 else 1.0
            got = index.vote(entries, sims, None if without is None else entry_of[i], (worth * labels[i], worth))
            assert abs(got - share) < 1e-6


def test_curve_rises_and_keeps_the_mean():
    votes = np.array([0.0, 0.1, 0.1, 0.2, 0.4, 0.5, 0.9, 1.0])
    labels = np.array([0.0, 1, 0, 0, 1, 0, 1, 1])
    x, y = toxicity.calibration(votes, labels, np.ones(8))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1


def test_toxicity_without_examples(spark, toxic):
    _, docs, labels = toxic
    out = toxicity.predictions(docs, labels.limit(0)).collect()
    assert all(r.score == 0 and r.predicted == 0 and r.evidence == [] for r in out)
    assert toxicity.predictions(docs.limit(0), labels).collect() == []
    only = toxicity.predictions(docs, labels.filter("toxic = 1")).collect()
    assert all(r.score == 1 for r in only)
