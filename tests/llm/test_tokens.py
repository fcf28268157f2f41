"""Packing, token files, SentencePiece: against the libraries themselves."""

import zlib

import numpy as np
import pytest

from provlens.llm import common, lattice, packing, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def ids(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [(d, t.encode(x or "", add_special_tokens=False).ids) for d, x in documents]


def test_encoder_equals_the_library():
    e = common.Encoder(PATH, keep=3)
    for text in ["it's İstanbul ΣΑΣ, 12 3e4 <|endoftext|>x!", "a b\x1cc\x85d　e​f", "Ab! ab. AB,", "ﬁ Å ÅB ＡＢ", "́x ́", "", None, "été, Été!?"]:
        for _ in range(2):
            assert e.ids(text).tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_takes_many_texts_at_once():
    import pyarrow as pa

    e = common.Encoder(PATH, keep=50)
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(map(chr, rng.integers(97, 103, rng.integers(1, 9)))) + mark for mark in rng.choice(["", ".", "%%%", "?!"], 90))
             for _ in range(30)]
    texts += [None, "", "\x85", "\x85 \u3000 a", " lead\ttrail ", "İstanbul ΣΑΣ ΟΔΟΣ ᾼ ǅ ﬁn", "a\x1cb", "Ab### x%$ ... <|endoftext|>", "ª ⅷ ²", "z" * 70]
    plain = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    calls = []
    made = e._made
    e._made = lambda parts: calls.append(len(parts)) or made(parts)
    for limit in (1 << 22, 300):
        got = list(e.each(pa.array(texts, pa.string()).slice(0), limit))
        assert [x.tolist() for x in got] == plain
        assert limit < 1000 or len(calls) == 1  # the tokenizer is asked once for all of them
    assert [x.tolist() for x in e.each(pa.array([None, *texts], pa.string()).slice(4, 9))] == plain[3:12]
    assert not list(e.each(pa.array([], pa.string()))) and [len(x) for x in e.each(pa.array([None, ""], pa.string()))] == [0, 0]


def test_packing_holds_every_id_once(docs, ids):
    rows = packing.pack_documents(docs, PATH, 2, length=256).collect()
    got, wanted = [], []
    for r in rows:
        got.append((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens))
    for d, x in ids:
        x = [*x, 2]
        wanted += [(d, a, len(x[a:a + 256]), crc(x[a:a + 256]), len(x)) for a in range(0, len(x), 256)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(got, key=key) == sorted(wanted, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    used = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
        used += at
    assert used / (256 * len(sequences)) > 0.9


def test_packed_ids_are_the_tokenizer_s(docs, ids):
    unique = docs.filter("doc_id < 20")
    packed = packing.pack_documents(unique, PATH, 2, length=128)
    whole = {(r.sequence_id, r.offset): r.ids for r in packing.packed_ids(unique, packed, PATH, 2).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id, r.offset] == [*dict(ids)[r.doc_id], 2][r.start:r.start + r.length]


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing, PATH, 2).collect() == []
    assert packing.plan({}, 16) == []


def test_column_generation_beats_or_meets_first_fit():
    histogram = {7: 30, 5: 41, 3: 25, 2: 11}
    out = packing.plan(histogram, 16)
    placed = {s: sum(p.get(s, 0) * n for p, n in out) for s in histogram}
    assert placed == histogram and all(sum(s * k for s, k in p.items()) <= 16 for p, _ in out)
    bound = -(-sum(s * n for s, n in histogram.items()) // 16)
    assert bound <= sum(n for _, n in out) <= bound + 2


def test_token_files_round_trip(docs, ids):
    rows = token_files.token_files(docs, PATH, 1).collect()
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)
    assert [g[1] for g in got] == sorted([d for d, _ in ids], key=lambda d: (d is not None, d))
    at = 0
    for start, d, n, c in got:
        assert start == at
        at += n
    assert sorted((d or -1, n, c) for _, d, n, c in got) == sorted((d or -1, len(x) + 1, crc([*x, 1])) for d, x in ids)


def test_token_files_of_nothing(nothing):
    assert token_files.token_files(nothing, PATH, 1).collect() == []


def test_shard_random_access_and_grammar():
    rng = np.random.default_rng(1)
    phrase = rng.integers(5, 300, 40)
    parts = [np.r_[rng.integers(5, 300, 30), phrase, phrase, rng.integers(5, 9, 200), 1] for _ in range(40)] + [np.array([1])]
    data = token_files.pack_shard(3, 4, [*range(40), None], [len(p) for p in parts], np.concatenate(parts), 1, 300)
    shard = token_files.Shard(data + b"\n")
    assert (shard.part, shard.number, shard.doc_ids[-1]) == (3, 4, None) and len(shard.sides)
    assert len(shard.symbols) < 0.6 * sum(map(len, parts))
    for i, p in enumerate(parts):
        assert shard.document(i).tolist() == p.tolist()
        for a, b in ((0, 1), (3, 50), (len(p) - 2, len(p)), (7, 7)):
            assert shard.document(i, max(a, 0), b).tolist() == p[max(a, 0):b].tolist()
    whole, ends = shard.all()
    assert whole.tolist() == np.concatenate(parts).tolist() and ends.tolist() == np.cumsum([len(p) for p in parts]).tolist()


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(2)
    common_pairs = rng.permutation(8000).reshape(-1, 2) + 2  # more pairs than any one round of few could take
    phrase = rng.integers(2, 8002, 100)
    texts = [np.r_[common_pairs[rng.permutation(4000)].ravel(), phrase, 1] for _ in range(20)]
    tokens = np.concatenate(texts)
    symbols, sides, sizes = token_files.compress(tokens, 1, 8002)
    free = (symbols[:-1] != 1) & (symbols[1:] != 1)
    counts = np.unique((symbols[:-1] << 32 | symbols[1:])[free], return_counts=True)[1]
    assert counts.max() < 16 and len(sides) > 4000 and sizes.max() > 16
    assert len(np.unique(sides, axis=0)) == len(sides)
    shard = token_files.Shard(token_files.pack_shard(0, 0, [*range(20)], [len(t) for t in texts], tokens, 1, 8002))
    assert shard.all()[0].tolist() == tokens.tolist() and shard.document(7, 7990, 8050).tolist() == texts[7][7990:8050].tolist()


def test_grammar_counts_only_what_a_round_changed(monkeypatch):
    from collections import Counter

    def plain(tokens, end_id, first_rule, least):
        symbols, rules = list(tokens), []
        while True:
            counts = Counter(p for p in zip(symbols, symbols[1:]) if end_id not in p)
            often = {p for p, n in counts.items() if n >= least}
            if not often:
                return symbols, rules
            out, used, i = [], [], 0
            while i < len(symbols):
                if tuple(symbols[i:i + 2]) in often:
                    used.append(tuple(symbols[i:i + 2]))
                    out.append(used[-1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            new = {p: first_rule + len(rules) + n for n, p in enumerate(sorted(set(used)))}
            rules += sorted(new)
            symbols = [new.get(x, x) if isinstance(x, tuple) else x for x in out]

    rng = np.random.default_rng(7)
    for n in range(60):
        tokens = np.tile(rng.integers(0, 6, int(rng.integers(1, 9))), 30) if n % 3 == 0 else rng.integers(0, 6, int(rng.integers(0, 300)))
        symbols, sides, _ = token_files.compress(tokens, 1, 20, least=4)
        assert (symbols.tolist(), [tuple(x) for x in sides.tolist()]) == plain(tokens.tolist(), 1, 20, 4)
    counted, sort = [], np.sort
    monkeypatch.setattr(np, "sort", lambda x: counted.append(len(x)) or sort(x))
    tokens = np.concatenate([np.r_[rng.integers(2, 90, 3000), 1] for _ in range(20)] + [np.tile(np.arange(2, 66), 40)])
    token_files.compress(tokens, 1, 90)
    assert len(counted) > 4 and counted[0] < len(tokens) and sum(counted) < 3 * len(tokens)


@pytest.mark.parametrize("first_rule, width", [(300, 2), (1 << 16, 3), (1 << 24, 4)])
def test_shard_with_symbols_of_any_width(first_rule, width):
    tokens = np.array([*[5, 6, 7] * 40, 1, 8, 1])
    data = token_files.pack_shard(0, 0, [1, 2], [121, 2], tokens, 1, first_rule)
    shard = token_files.Shard(data + b"\n")
    assert token_files.struct.unpack_from(token_files._HEAD, data)[7] == width and len(shard.symbols) < 40
    assert shard.all()[0].tolist() == tokens.tolist() and shard.document(1).tolist() == [8, 1]


def test_sentencepiece_equals_the_library_and_comes_back(spark, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(d, t) for d, t in documents if t is None or len(t) < 3000]
    rows += [(200, "a  b   c\n\td ☃ 😀x ́ "), (201, "\n"), (202, " lead and trail "),
             (203, "internationalization" * 8 + " " + "the" * 21), (204, "a" * 61 + " " + "b" * 62 + " " + "ab" * 31)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lattice.decode(lattice.encode(df, MODEL), MODEL).collect()
    key = lambda r: (r[0] is not None, r[0], r[1])
    got = sorted(((r.doc_id, r.text, np.frombuffer(r.ids, "<i4").tolist(), r.n_tokens) for r in out), key=key)
    wanted = sorted(((d, t or "", model.encode(t or ""), len(model.encode(t or ""))) for d, t in rows), key=key)
    assert got == wanted


def test_sentencepiece_of_long_words(spark, documents):
    import random

    import sentencepiece

    rng = random.Random(5)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = "ABCDEFabcdefghijklmnop0123456789+/"
    rows = [(d, t) for d, t in documents if t is not None and len(t) >= 3000]
    rows += [(300, "".join(rng.choice(letters) for _ in range(20000))), (301, "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(8000))),
             (302, "internationalizationof" * 900 + " then short"), (303, "é" * 59), (304, "ab" * 30 + " " + "ab" * 29 + "a"), (305, " " * 9000 + "x")]
    out = lattice.decode(lattice.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL), MODEL).collect()
    got = {r.doc_id: (np.frombuffer(r.ids, "<i4").tolist(), r.text) for r in out}
    assert len(out) == len(rows) and any(len(t) == 50000 for _, t in rows)
    assert got == {d: (model.encode(t), t) for d, t in rows}


def test_long_words_follow_the_folds(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    scores = {"a": -1.0, "b": -1.5, "ab": -2.2, "bc": -1.1, "c": -3.0, "abc": -4.0, "d": -1.0, "aa": -2.0}
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 40))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(2, "word")
    for merges in (False, True):
        pieces = lattice.Pieces([(p, i, s) for i, (p, s) in enumerate(scores.items())], list(range(100, 356)), 3, [], merges)
        folded = {r.word: r.ids for r in lattice.word_ids(df, pieces).select("word", F.col("ids")).collect()}
        table = {p: (i, s) for p, i, s in pieces.rows}
        assert folded == {w: lattice.long_ids(w, pieces, table) for w in words}


def test_lattices_fall_apart_where_no_piece_leads_over():
    import sentencepiece

    rng = np.random.default_rng(8)
    letters = list("abcdeéñ中😀%#,.A0\n\x00") + ["▁"]
    words = ["".join(rng.choice(letters, rng.integers(1, 50))) for _ in range(400)] + ["▁the", "▁the%%%", "thing", "▁thing,"]
    parts, counts = lattice._parts(words, MODEL)
    assert "".join(parts) == "".join(words) and sum(counts) == len(parts) and len(set(parts)) < len(parts)
    pieces, table = lattice._piece_table(MODEL)
    assert lattice._parts([p for p, _, _ in pieces.rows], MODEL)[1] == [1] * len(pieces.rows)
    ids, sizes = lattice.fold(parts, pieces, lattice._prefixes(MODEL))
    ends = np.r_[0, np.cumsum(sizes)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [lattice.long_ids(p, pieces, table) for p in parts]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = " the thing%%% a,b  été 中😀"
    assert lattice.fold(lattice._parts(lattice.cut(text), MODEL)[0], pieces, lattice._prefixes(MODEL))[0].tolist() == model.encode(text)
    some = sorted(set(parts))
    assert lattice._opened(lattice._bundle(some)) == some and lattice._opened(lattice._bundle([])) == []


def test_words_are_cut_alike_with_and_without_odd_blanks():
    rng = np.random.default_rng(9)
    for n in range(600):
        text = "".join(rng.choice(list("ab \n") if n % 2 else list("ab  \n\t\r\0") + ["▁"], rng.integers(0, 25)))
        assert lattice.cut(text) == (lattice._CUT.findall(("▁" + text).replace(" ", "▁")) if text else [])


def test_sentencepiece_sends_no_row_for_a_word(spark):
    rows = [(i, " ".join(f"word{(i * 37 + k) % 500}{mark}" for k in range(200) for mark in ("", "%%%"))) for i in range(40)]
    out = lattice.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), MODEL)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "word" not in plan and out.count() == 40


def test_sentencepiece_of_nothing(nothing):
    assert lattice.decode(lattice.encode(nothing, MODEL), MODEL).collect() == []


def test_sentencepiece_holds_the_words_of_one_text_and_the_texts_of_one_run(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(f"word{k}" for k in range(2000)) for _ in range(200)]
    lattice._different(texts[:1], MODEL, 8)
    tracemalloc.start()
    words = lattice._different(texts, MODEL, 8)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 2000 and peak < 5e6  # all texts' words at once are 20 MB and more

    df = spark.createDataFrame([], "doc_id long, n_tokens long, ids binary")
    found = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: found.append(f) or self)
    lattice.decode(df, MODEL)
    ids = [None, b"", *[np.full(n, 500 + n % 7, "<i4").tobytes() for n in (3, 400_000, 200_000, 100_000, 5, 100_000)]]
    whole = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(range(8)), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
    out = list(found[0](iter([whole])))
    assert [b.num_rows for b in out] == [3, 1, 1, 3]
    got = pa.Table.from_batches(out)
    assert got.select(whole.schema.names).to_pylist() == whole.to_pylist()
    one = [next(found[0](iter([whole.slice(i, 1)]))).column("text")[0].as_py() for i in range(8)]
    assert got.column("text").to_pylist() == one


def test_viterbi_fold_finds_the_best_path(spark):
    from pyspark.sql import functions as F

    scores = {"a": -1.0, "b": -1.5, "ab": -2.2, "bc": -1.1, "c": -3.0, "abc": -4.0, "d": -1.0}
    pieces = lattice.Pieces([(p, i, s) for i, (p, s) in enumerate(scores.items())], list(range(100, 356)), 3, [], False)
    words = ["abc", "abcd", "d", "axb", "xx", "cab", "é"]
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(2, "word")
    got = {r.word: r.ids for r in lattice.word_ids(df, pieces).select("word", F.col("ids")).collect()}

    def best(w):
        found = [(0.0, [])]
        for e in range(1, len(w) + 1):
            options = [(found[e - 1][0] + lattice.BYTE_SCORE, 1 - e, found[e - 1][1] + [100 + x for x in w[e - 1].encode()])]
            for b in range(e):
                if w[b:e] in scores:
                    options.append((found[b][0] + scores[w[b:e]], -b, found[b][1] + [list(scores).index(w[b:e])]))
            s, _, i = max(options)
            found.append((s, i))
        return found[-1][1]

    assert got == {w: best(w) for w in words}
