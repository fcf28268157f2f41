"""The pipeline on its own small documents: every stage's decisions, compared with plain ones."""

import corpus_pipeline
from conftest_words import words
from provlens.llm import common, quality


def test_stages_in_order(spark, docs, documents):
    held, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.landed(stage(spark, held, ""), "test")
        assert out.columns == docs.columns
        kept[name] = {r.doc_id: r for r in out.collect()}
        held = out
    texts = dict(documents)
    first = kept["quality rules"]
    assert set(first) == {r.doc_id for r in quality.report(docs).collect() if r.kept} and set(range(95)) <= set(first)
    assert set(range(60)) <= set(kept["language id"])
    # Near copies 60 to 74, the copies 75 to 84 and 106 go; what is left is no copy of anything.
    near = set(kept["near duplicates"])
    sets = {d: {tuple(words(texts[d])[i:i + 5]) for i in range(len(words(texts[d])) - 4)} for d in kept["language id"]}
    for d in kept["language id"]:
        earlier = [e for e in sets if e < d and len(sets[e] & sets[d]) >= 0.8 * len(sets[e] | sets[d])]
        assert (d in near) == (not earlier), d
    seen = set()
    for d in sorted(near):
        ws = words(texts[d])
        grams = [tuple(ws[i:i + 13]) for i in range(len(ws) - 12)]
        gone = {i + k for i, g in enumerate(grams) if g in seen for k in range(13)}
        row = kept["substring dedup"][d]
        assert row.text == (texts[d] if not gone else " ".join(w for i, w in enumerate(ws) if i not in gone))
        assert row.n_chars == len(row.text)
        seen |= set(grams)
    packed = corpus_pipeline.STAGES[-1][1](spark, held, "").collect()
    assert {r.doc_id for r in packed} == near
    for d in near:
        own = sorted((r.start, r.length, r.doc_tokens) for r in packed if r.doc_id == d)
        assert sum(n for _, n, _ in own) == own[0][2]


def test_names_and_shape():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
