"""Quality, substrings, language, near copies, fingerprints: against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest_words import words

from provlens.llm import common, components, fingerprints, jaccard, language, quality, substring


def counts(text):
    ws = words(text)
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(docs, documents):
    rows = quality.report(docs).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                 for r in rows)
    wanted = []
    for d, t in documents:
        c = counts(t)
        wanted.append((-1 if d is None else d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(wanted)
    kept = {r.doc_id for r in rows if r.kept}
    assert not kept & {None, 95, 96, 97, 98, 99, 100, 102, 103, 104} and kept >= set(range(60))


def test_quality_order_changes_nothing(docs):
    one = {r.doc_id for r in quality.kept_documents(docs, sample=1).collect()}
    two = {r.doc_id for r in quality.kept_documents(docs, sample=1000).collect()}
    assert one == two == {r.doc_id for r in quality.report(docs).collect() if r.kept}
    assert quality.kept_documents(docs).columns == docs.columns


def test_quality_orders_by_rejections_per_cost(docs):
    from pyspark.sql import functions as F

    rules = [quality.Rule("never", F.lit(False)), quality.Rule("often", F.length("text") > 100)]
    assert [r.name for r, _, _ in quality.estimate(docs, rules)] == ["often", "never"]


def test_substrings(docs, documents):
    first = {}
    for d, t in documents:
        ws = words(t)
        d = -1 if d is None else d
        for i in range(len(ws) - 12):
            g = tuple(ws[i:i + 13])
            first[g] = min(first.get(g, d), d)
    wanted = []
    for d, t in documents:
        ws = words(t)
        d = -1 if d is None else d
        gone = {i + k for i in range(len(ws) - 12) if first[tuple(ws[i:i + 13])] < d for k in range(13)}
        wanted.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    out = substring.dedup(docs)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect())
    assert got == sorted(wanted) and sum(w[2] for w in wanted) > 2000
    assert out.columns == [*docs.columns, "kept_text", "n_words", "n_removed"]
    cut = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    assert cut[101].text == dict(documents)[101] and cut[80].text == "" and cut[80].n_chars == 0


def test_substrings_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BITS", 2)
    rng = random.Random(5)
    shared = " ".join(rng.choice("abcdefgh") for _ in range(15))
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) + " " + shared) for i in range(60)]
    got = {r.doc_id: r.n_removed for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got[0] == 0 and all(got[i] >= 15 for i in range(1, 60))


def test_jaccard_classes(docs, documents):
    sets = []
    for d, t in documents:
        ws = words(t)
        sets.append({tuple(ws[i:i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set())
    n = len(sets)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = [-1 if d is None else d for d, _ in documents]
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    wanted = sorted((ids[i], least[find(i)], links[i]) for i in range(n))
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in jaccard.classes(docs).collect())
    assert got == wanted and sum(x > 0 for x in links) > 25


def test_jaccard_blocks_meet(docs, monkeypatch):
    whole = sorted(jaccard.classes(docs).collect(), key=str)
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 2)
    assert sorted(jaccard.classes(docs).collect(), key=str) == whole


def test_many_near_copies_are_compared_exactly():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[rng.integers(0, 200, 12)] = rng.integers(0, 1 << 62, 12).astype(np.uint64)
        sets.append(np.unique(s))
    sigs = np.stack([jaccard.signature(s) for s in sets])
    rows = np.arange(60)
    a, b = jaccard.compare(sigs, sets, rows, rows, 0.8, jaccard.least_matches(0.8, 1e-6))
    wanted = {(i, j) for i in range(60) for j in range(i + 1, 60)
              if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    assert set(zip(a.tolist(), b.tolist())) == wanted and len(wanted) > 500


def test_pruning_bounds_rise_and_are_lenient():
    needed = jaccard.least_matches(0.8, 1e-6)
    assert [n for n, _ in needed] == list(range(15, 151, 15)) and all(m < 0.8 * n for n, m in needed)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(50, 50)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_language_learns_and_predicts(spark):
    rng = random.Random(7)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["zer", "vin", "qua", "ob"], "cc": ["ка", "ло", "ми"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40))
        wrong = rng.random() < 0.05
        rows.append((i, text, rng.choice(list(parts)) if wrong else lang, lang))
    rows += [(1000, None, "aa", None), (1001, "12 !!", None, None), (1002, "", "bb", None), (None, "kalo mitu", "aa", "aa"), (1003, "ΩΩ", None, None)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predictions(df).collect()}
    truth = {r[0]: r[3] for r in rows}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    right = [got[d].lang_pred == truth[d] for d in truth if truth[d] and got[d].held_out]
    assert sum(right) / len(right) > 0.95 and len(right) > 40
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1000, 1001, 1002)) and got[1003].lang_pred in parts
    assert language.in_known_language(df).columns == df.columns


def test_language_forgets_what_other_steps_keep(spark, monkeypatch):
    import pyarrow as pa

    df = spark.createDataFrame([], "doc_id long, text string")
    model = language.Model(["aa"], np.full(64, 1, np.uint64), np.zeros(1))
    found = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: found.append(f) or self)
    language.identify(df, model)
    texts = [None, "", "ab cd", "x" * (1 << 20), "ef " * 400_000, "é", "12"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    common.kept(("encoder", "test"), lambda: "words")
    out = pa.Table.from_batches(list(found[0](iter([batch]))))
    assert common.kept(("encoder", "test"), lambda: "anew") == "anew"
    assert out.select(["doc_id", "text"]).to_pylist() == batch.to_pylist()
    assert out.column("lang_pred").to_pylist() == ["und", "und", "aa", "aa", "aa", "aa", "und"]
    common.lean("encoder")
    assert common.kept(("encoder", "test"), lambda: "new") == "anew"
    common.lean()
    assert common.kept(("encoder", "test"), lambda: "new") == "new"
    common.lean()


def test_texts_come_in_runs():
    import pyarrow as pa

    column = pa.array(["a" * 6, None, "b" * 5, "c" * 30, "", "d" * 4])
    for some in (column, pa.concat_arrays([pa.array(["z" * 9]), column]).slice(1)):
        assert [r.to_pylist() for r in common.runs(some, 10)] == [["a" * 6, None], ["b" * 5], ["c" * 30], ["", "d" * 4]]
    assert list(common.runs(column.slice(0, 0), 10)) == []


def test_language_with_nothing_to_learn_from(docs, nothing):
    model = language.learn(nothing)
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}
    assert language.predictions(nothing).collect() == []


def test_ngrams_do_not_reach_into_the_next_text():
    h, whose, letters = language.ngrams(["ab", "", "ab", "b 1 a"], (2, 4))
    of = lambda i: sorted(h[whose == i].tolist())
    assert of(0) == of(2) and len(of(0)) == 4 and of(1) == [] and letters.tolist() == [2, 0, 2, 2] and len(of(3)) == 4


def test_fingerprints(docs, documents):
    rows = fingerprints.versions(docs).collect()
    order = sorted([(d, t or "") for d, t in documents], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    wanted = []
    for i, (d, t) in enumerate(order):
        x = order[(i + 1) % len(order)][1]
        e = t[:len(t) - len(t) // 2] + x[:len(t) // 2]
        owner, digests = fingerprints.pieces([t, e, x])
        s = [set(digests[owner == k].tolist()) for k in range(3)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        wanted.append((-1 if d is None else d, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(s[0], s[1]), 9), round(like(s[0], s[2]), 9)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert sorted(got) == sorted(wanted)
    alike = {}
    for r in rows:
        text = dict(documents)[r.doc_id] or ""
        assert alike.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(alike.values())) == len(alike)
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert all(plain[r.doc_id] == r.fingerprint for r in rows)


def test_difference_of_two_fingerprints():
    a = "\n".join(f"line {i}" for i in range(40))
    b = a.replace("line 7\n", "line seven\n")
    owner, digests = fingerprints.pieces([a, b])
    one, two = fingerprints.sketch(owner, digests, 2).strings()
    gone, new = fingerprints.difference(one, two)
    sets = [set(digests[owner == i].tolist()) for i in (0, 1)]
    assert gone == sets[0] - sets[1] and new == sets[1] - sets[0]
    far = fingerprints.sketch(*fingerprints.pieces(["\n".join(map(str, range(500)))]), 1).strings()[0]
    assert fingerprints.difference(one, far) is None


def test_one_of_each_decides_by_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (1, text(1)), (5, text(1)),  # repeated rows that are the first of their class
            (None, text(2)), (None, text(2)), (7, text(2)),
            (0, text(3)), (2, text(3)), (2, text(4)),  # one text under id 2 is a copy, the other is not
            (3, text(5)), (3, text(5) + " more"),  # near copies under one id
            (4, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()]
    near = [g for g in got if g[0] == 3]
    assert len(near) == 1 and near[0] in rows
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted((g for g in got if g[0] != 3), key=key) == sorted(
        [(1, text(1)), (None, text(2)), (0, text(3)), (2, text(4)), (4, ""), (4, None)], key=key)


@pytest.mark.parametrize("operator", [quality.report, quality.kept_documents, substring.dedup, substring.without_repeats, jaccard.classes,
                                      jaccard.one_of_each, fingerprints.versions, fingerprints.fingerprints, language.in_known_language])
def test_empty_tables(nothing, operator):
    assert operator(nothing).collect() == []
