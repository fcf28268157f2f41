import random

from pyspark.sql import functions as F

from provlens.functions import ordered
from provlens.functions.documents import items, record_digest
from tests.conftest import canon, sha


def skewed(n=600, seed=3):
    """Two thirds of the rows share one key."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.66 else f"k{rnd.randrange(9)}", rnd.randrange(10**6), i) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "k string, a long, b long").repartition(5)


def test_sequenced_positions_and_previous(spark):
    data = skewed()
    out = ordered.sequenced(frame(spark, data), ["k"], ["a", "b"], ["a"]).collect()
    want = {}
    for k in {d[0] for d in data}:
        rows = sorted((a, b) for kk, a, b in data if kk == k)
        for i, (a, b) in enumerate(rows):
            want[(k, a, b)] = (i, rows[i - 1][0] if i else None)
    assert {(r.k, r.a, r.b): (r.position, r.prev_a) for r in out} == want


def test_sequenced_spans_several_slices(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = frame(spark, [("hot", i * 7 % 1000, i) for i in range(1000)])
        out = ordered.sequenced(df, ["k"], ["a", "b"], ["b"])
        rows = sorted((r.position, r.a) for r in out.collect())
        assert [p for p, _ in rows] == list(range(1000)) and [a for _, a in rows] == sorted(a for _, a in rows)
        sums = ordered.running(df, ["k"], ["a", "b"], {"s": ("sum", "a"), "m": ("max", "a"), "n": ("min", "b")}).collect()
        total, low = 0, None
        for r in sorted(sums, key=lambda r: (r.a, r.b)):
            total += r.a
            low = r.b if low is None else min(low, r.b)
            assert (r.s, r.m, r.n) == (total, r.a, low)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_running_matches_brute_force(spark):
    data = skewed(300)
    out = ordered.running(frame(spark, data), ["k"], ["a", "b"], {"s": ("sum", "a")}).collect()
    for r in out:
        assert r.s == sum(a for k, a, b in data if k == r.k and (a, b) <= (r.a, r.b))


def test_record_digest_equals_whole_text(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_CHARS", 40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        data = skewed(400)
        df = frame(spark, data)
        heads = df.select("k").distinct().unionByName(spark.sql("SELECT 'none' AS k"))
        text = F.concat(F.lit('{"n":'), F.col("b").cast("string"), F.lit(',"t":"é"}'))
        lst = items(df, ["k"], F.lpad(F.col("b").cast("string"), 9, "0"), text)
        got = {r.k: r.d for r in record_digest(heads, ["k"], {
            "z": lst, "inner": {"list": lst, "name": F.concat(F.lit('"'), "k", F.lit('"'))}, "v": F.lit('"1"')},
            "d").collect()}
        for k in {d[0] for d in data} | {"none"}:
            rows = [{"n": b, "t": "é"} for kk, _, b in data if kk == k]
            assert got[k] == sha(canon({"z": rows, "inner": {"list": rows, "name": k}, "v": "1"}))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
