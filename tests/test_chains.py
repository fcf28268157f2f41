import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provlens import schemas
from provlens.operators import chains
from tests.conftest import chain

COLUMNS = ["archive_id", "pos", *[f.name for f in schemas.AUDIT_ENTRY.fields]]
SCHEMA = ("archive_id string, pos long, seq long, prev_hash string, timestamp string, actor string, action string, "
          "target string, parameters map<string,string>, result string, schema_version string, entry_hash string")


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA).repartition(3)


def verdict(spark, rows):
    return {r.archive_id: r for r in chains.verify_chain(frame(spark, rows)).collect()}


def renumber(rows):
    return [{**r, "pos": i} for i, r in enumerate(rows)]


def brute(rows):
    """First failure in log order, found by walking the log."""
    from tests.conftest import canon, sha
    seq, prev = 0, "0" * 64
    for r in rows:
        body = {k: r[k] for k in COLUMNS if k not in ("archive_id", "pos", "entry_hash")}
        if r["seq"] != seq:
            return r["seq"], "seq"
        if r["prev_hash"] != prev:
            return r["seq"], "prev_hash"
        if sha(canon(body)) != r["entry_hash"]:
            return r["seq"], "entry_hash"
        seq, prev = r["seq"] + 1, r["entry_hash"]
    return None


@pytest.mark.parametrize("span", [2, 3, 1 << 16])
def test_honest_chains_verify(spark, monkeypatch, span):
    monkeypatch.setattr(chains, "SPAN", span)
    out = verdict(spark, chain("a", 13) + chain("b", 1) + chain("c", 6))
    assert all(r.ok and r.first_failure_seq is None for r in out.values())
    assert {k: r.total_entries for k, r in out.items()} == {"a": 13, "b": 1, "c": 6}


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 9), st.integers(0, 8), st.sampled_from(["cut", "swap", "edit", "relink", "rehash"]))
def test_any_change_is_found_where_it_is(spark, n, at, how):
    rows = chain("a", n)
    at %= n
    if how == "cut":
        rows = rows[:at] + rows[at + 1:]
    elif how == "swap":
        rows[at], rows[0] = rows[0], rows[at]
    elif how == "edit":
        rows[at] = {**rows[at], "parameters": {"size_bytes": "x"}}
    elif how == "relink":
        rows[at] = {**rows[at], "prev_hash": "f" * 64}
    else:
        rows[at] = {**rows[at], "entry_hash": "e" * 64}
    rows = renumber(rows)
    out = verdict(spark, rows)
    want = brute(rows)
    if not rows:
        assert out == {}
    elif want is None:
        assert out["a"].ok
    else:
        assert (out["a"].first_failure_seq, out["a"].first_failure_reason.split(" ")[0]) == want


def test_all_failures_in_sequence_order(spark):
    rows = chain("a", 6)
    rows[2] = {**rows[2], "actor": "someone"}
    rows[4] = {**rows[4], "prev_hash": "f" * 64}
    rows = renumber(list(reversed(rows)))
    out = [(r.seq, r.reason) for r in chains.verify_chain_all(frame(spark, rows)).collect()]
    assert out == [(2, "entry_hash mismatch"), (4, "entry_hash mismatch"),
                   (4, "prev_hash does not match entry_hash of seq 3")]


@pytest.mark.parametrize("round_rows", [1, 4, 1000])
def test_append_continues_the_log(spark, round_rows):
    old = chain("a", 5)
    new = frame(spark, chain("a", 7, 5) + chain("b", 3)).drop("pos", "seq", "prev_hash", "entry_hash")
    new = new.withColumn("o", F.element_at("parameters", "size_bytes").cast("long"))
    got = chains.append_chain(frame(spark, old), new, ["o"], round_rows).collect()
    want = {(r["archive_id"], r["seq"]): (r["pos"], r["prev_hash"], r["entry_hash"])
            for r in chain("a", 12)[5:] + chain("b", 3)}
    assert {(r.archive_id, r.seq): (r.pos, r.prev_hash, r.entry_hash) for r in got} == want


def test_heads_pages_and_gaps(spark):
    from provlens.operators import sets
    log = frame(spark, chain("a", 4))
    archives = spark.createDataFrame([("a",), ("empty",)], "archive_id string")
    heads = {r.archive_id: (r.head_hash, r.total) for r in chains.chain_head(log, archives).collect()}
    assert heads == {"a": (chain("a", 4)[-1]["entry_hash"], 4), "empty": ("0" * 64, 0)}
    page = chains.page(log, 1, 2).collect()
    assert [(r.pos, r.total) for r in page] == [(1, 4), (2, 4)]
    seqs = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("b", 7)], "archive_id string, sequence long")
    assert sorted(r.missing_sequence for r in sets.sequence_gaps(seqs).collect()) == [2, 3]
    wide = spark.createDataFrame([("a", 0), ("a", 10_000_000_001), ("b", 5), ("b", 200_006)], "archive_id string, sequence long")
    ranges = {r.archive_id: (r.first_missing, r.last_missing) for r in sets.sequence_gap_ranges(wide).collect()}
    assert ranges == {"a": (1, 10_000_000_000), "b": (6, 200_005)}
    assert sets.sequence_gaps(wide.filter("archive_id = 'b'")).distinct().count() == 200_000


def test_header_consensus_counts_sources(spark):
    from provlens.operators import aggregates
    rows = [(1, "s", "aa"), (1, "s", "aa"), (2, "s", "aa"), (2, "t", "aa"), (3, "s", "aa"), (3, "s", "bb"), (4, "s", "aa"), (4, "t", "bb")]
    got = {r.height: (r.sources, r.status) for r in aggregates.header_consensus(
        spark.createDataFrame(rows, "height long, source string, header_hex string")).collect()}
    assert got == {1: (1, "too_few_sources"), 2: (2, "agreed"), 3: (1, "disagreement"), 4: (2, "disagreement")}


def test_transparency_chain_reports_the_first_failure(spark):
    from tests.conftest import canon, sha
    fields = [f.name for f in schemas.TRANSPARENCY.fields]
    rows, prev = [], "0" * 64
    for i in range(3):
        m = {f: "x" for f in fields}
        m |= {f.name: 0 for f in schemas.TRANSPARENCY.fields if f.dataType.simpleString() == "bigint"}
        m |= {"sequence": i, "previous_manifest_hash": prev}
        prev = m["manifest_hash"] = sha(canon({k: v for k, v in m.items() if k != "manifest_hash"}))
        rows.append(m)

    def check(ms):
        df = spark.createDataFrame([("a", *[m[f] for f in fields]) for m in ms],
                                   "archive_id string, " + ", ".join(
                                       f"{f.name} {f.dataType.simpleString()}" for f in schemas.TRANSPARENCY.fields))
        return chains.verify_transparency_chain(df).first()

    assert check(rows).ok
    assert check([rows[0], rows[2]]).reason == "sequence mismatch at index 1: expected 1, got 2"
    assert check([rows[0], {**rows[1], "signature": "y"}, rows[2]]).reason == \
        "manifest at sequence 1 failed structural verification"


def test_skewed_logs_stay_whole(spark):
    """Adaptive skew handling must not deal one log out to several tasks."""
    tight = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
             "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in tight}
    for k, v in tight.items():
        spark.conf.set(k, v)
    try:
        i = F.col("id")
        new = spark.range(6000).select(
            F.when(i % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("a"), (i % 40).cast("string"))).alias("archive_id"),
            i.alias("o"), F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.lit("op").alias("actor"),
            F.lit("ingest_evidence").alias("action"), F.concat(F.lit("t"), i.cast("string")).alias("target"),
            F.create_map(F.lit("k"), i.cast("string")).alias("parameters"), F.lit("success").alias("result"),
            F.lit("0.1.0").alias("schema_version")).repartition(6)
        log = chains.append_chain(None, new, ["o"], 700)
        out = chains.verify_chain(log).collect()
        assert sum(r.total_entries for r in out) == 6000 and all(r.ok for r in out)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_repeated_headers_and_references_count_once(spark):
    from provlens.operators import joins
    root, other = "ab" * 32, "cd" * 32
    claims = spark.createDataFrame([(1, root), (2, root), (3, root)], "height long, merkle_root string")
    header = lambda r: "0" * 72 + r + "0" * 24
    headers = spark.createDataFrame([(1, header(root)), (1, header(root)), (2, header(root)), (2, header(other))], "height long, header_hex string")
    got = joins.anchor_match(claims, headers).collect()
    assert sorted((r.height, r.anchored) for r in got) == [(1, True), (2, False), (3, False)]
    refs = spark.createDataFrame([("x", "https_pem", "u", "f2"), ("x", "https_pem", "v", "f9"), ("x", "https_pem", "n", "f1")],
                                 "archive_id string, kind string, uri string, declared_fingerprint string")
    fetched = spark.createDataFrame([("https_pem", "u", ["f1"]), ("https_pem", "u", ["f2"]), ("https_pem", "v", ["f1"]), ("https_pem", "v", ["f1"]),
                                     ("https_pem", "n", None)], "kind string, uri string, fingerprints array<string>")
    got = joins.footprint_status(refs, fetched).collect()
    assert sorted((r.uri, r.status) for r in got) == [("n", "unreachable"), ("u", "verified"), ("v", "mismatch")]
