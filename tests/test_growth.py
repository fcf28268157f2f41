"""What keeps work, memory and shuffles in step with the input: whole groups, carried rows, single listings."""

import re

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from provlens.functions import ordered
from provlens.operators import chains, graph, media
from provlens.sources import archive_files, readers, writers
from provlens.streaming import chain_state
from tests.conftest import chain
from tests.test_chains import frame


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [0, 1 << 16])
def test_whole_groups_and_slices_number_alike(spark, monkeypatch, rows):
    monkeypatch.setattr(ordered, "GROUP_ROWS", rows)
    data = [(f"k{i % 3}" if i % 7 else None, i * 37 % 101, i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, a long, b long").repartition(5)
    out = ordered.sequenced(df, ["k"], ["a", "b"], ["a"])
    want = {}
    for k in ("k0", "k1", "k2"):
        mine = sorted((a, b) for kk, a, b in data if kk == k)
        want |= {(k, a, b): (i, mine[i - 1][0] if i else None) for i, (a, b) in enumerate(mine)}
    assert out.columns == ["k", "a", "b", "prev_a", "position"]
    assert {(r.k, r.a, r.b): (r.position, r.prev_a) for r in out.collect()} == want


def test_small_groups_are_numbered_in_one_shuffle(spark):
    df = spark.range(500).select((F.col("id") % 5).alias("k"), "id")
    plan = plan_of(ordered.sequenced(df, ["k"], ["id"], ["id"]))
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("rows, round_rows", [(0, 3), (0, 1000), (1 << 16, 3), (1 << 16, 1000)])
def test_logs_are_chained_alike_in_rounds_and_at_once(spark, monkeypatch, rows, round_rows):
    for module in (ordered, chains):
        monkeypatch.setattr(module, "GROUP_ROWS", rows)
    entries = [r for name in "abc" for r in chain(name, 9)]
    new = frame(spark, entries).drop("pos", "seq", "prev_hash", "entry_hash")
    new = new.withColumn("o", F.element_at("parameters", "size_bytes").cast("long")).repartition(4)
    log = chains.append_chain(None, new, ["o"], round_rows)
    if rows and round_rows == 1000:
        assert plan_of(log).count("Exchange") == plan_of(new).count("Exchange") + 1 and "Join" not in plan_of(log)
    got = {(r.archive_id, r.pos): (r.entry_hash, r.prev_hash, r.parameters, r.target) for r in log.collect()}
    assert got == {(r["archive_id"], r["pos"]): (r["entry_hash"], r["prev_hash"], r["parameters"], r["target"]) for r in entries}


def test_local_folders_are_listed_entry_by_entry(tmp_path):
    folder = tmp_path / "a" / "justifications"
    folder.mkdir(parents=True)
    for i in range(5000):
        (folder / f"{i:064d}.json").touch()
    listing = []

    class Whole(fs.LocalFileSystem):
        def get_file_info(self, what):
            if isinstance(what, fs.FileSelector):
                listing.append(what)
            return super().get_file_info(what)

    reader = archive_files.ArchiveFilesReader({"root": str(tmp_path), "pattern": "justifications/*.json"})
    found = list(reader._files(Whole(), archive_files.ArchiveSlice("a", str(tmp_path / "a"), 0, 1)))
    assert len(found) == 5000 and not listing


class _List:
    """A list state that counts calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.calls += 1
        self.rows += rows


def test_state_of_a_part_takes_two_calls_a_batch():
    follower, state = chain_state.ChainFollower(100, None), _List()
    follower.part = state
    rows = {r["pos"]: (r["seq"], r["prev_hash"], r["entry_hash"], r["entry_hash"]) for r in chain("a", 60)}
    rows[50] = (50, "f" * 64, rows[50][2], rows[50][3])
    out = []
    for came in (range(40, 60), range(20, 40), range(20)):
        out += [f["pos"] for f in follower._judged("a", 0, {p: rows[p] for p in came}, None, False)]
    assert out == [50] and state.calls == 6 and len(state.rows) == 1
    follower.part = _List()  # after an entry without a number the table, too, expects 0
    rows[3] = (None, *rows[3][1:])
    found = list(follower._judged("a", 0, {p: rows[p] for p in range(6)}, None, False))
    assert [(f["pos"], f["expected_seq"]) for f in found] == [(3, 3), (4, 0)]


def test_closures_of_forests_drop_no_repeats(spark):
    nodes = spark.createDataFrame([("a", k, n) for k, n in [("x", "1"), ("y", "1"), ("y", "2"), ("z", "1"), ("z", "2")]],
                                  "archive_id string, kind string, id string")
    forest = [("a", "e", "y", "1", "x", "1"), ("a", "e", "y", "2", "x", "1"), ("a", "e", "z", "1", "y", "1"), ("a", "e", "z", "2", "y", "2")]
    for pairs, repeats in ((forest, False), ([*forest, ("a", "e", "z", "1", "y", "2")], True)):
        out = graph.impact(nodes, spark.createDataFrame(pairs, ", ".join(f"{c} string" for c in graph.EDGE)), nodes)
        got = [(r.root_id, r.node_kind, r.node_id, r.distance) for r in out.filter("root_kind = 'x'").collect()]
        assert sorted(got) == [("1", "y", "1", 1), ("1", "y", "2", 1), ("1", "z", "1", 2), ("1", "z", "2", 2)]
        assert bool(re.search(r"keys=\[archive_id#\d+, root#\d+, \w+#\d+", plan_of(out))) == repeats


def test_small_logs_are_listed_in_few_tasks_and_opened_once(spark, tmp_path):
    root = str(tmp_path / "logs")
    entries = frame(spark, [r for i in range(40) for r in chain(f"a{i}", 2)])
    line = F.to_json(F.struct(*[c for c in entries.columns if c not in ("archive_id", "pos")]))
    writers.write_files(entries.groupBy("archive_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", line.alias("v")))), lambda r: r["v"]), "\n").alias("content")).select(
        "archive_id", F.lit("audit.log").alias("path"), "content"), root)
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None)
    out = readers.scan_audit(spark, root)
    assert "FileScan text" not in plan_of(out)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None) == before
    assert sorted((r.archive_id, r.pos, r.seq) for r in out.collect()) == sorted((f"a{i}", n, n) for i in range(40) for n in range(2))


def test_media_chains_are_grouped_without_a_join(spark):
    e = "ab" * 32
    rows = [("a", e, "1", None, True, "x"), ("a", e, "2", "1", True, e.upper()),
            ("a", "two", "1", None, True, "two"), ("a", "two", "2", None, True, "two"),
            ("a", "copies", "1", None, True, "c"), ("a", "copies", "2", "1", True, "c"), ("a", "copies", "2", "1", True, "c"),
            ("a", "lost", "1", None, True, "x"), ("a", "lost", "3", "2", True, "lost"),
            ("a", "sig", "1", None, None, "sig"), ("a", "fork", "1", None, True, "x"), ("a", "fork", "2", "1", True, "x"),
            ("a", "fork", "3", "1", True, "x"), ("a", "bare", "1", None, True, None), ("a", "other", "1", None, True, "x"),
            ("a", None, "1", None, True, "x"), ("a", None, "2", "1", True, "x"), ("a", "rootless", "2", "2", True, "x")]
    df = spark.createDataFrame(rows, "archive_id string, evidence_sha256 string, label string, parent_label string, "
                                     "signature_verified boolean, declared_sha256 string")
    out = media.media_chain_status(df)
    assert "Join" not in plan_of(out)
    assert {r.evidence_sha256: r.failure_reason for r in out.collect()} == {
        e: None, "two": "expected one root, found 2", "copies": "duplicate labels", "lost": "unknown parent",
        "sig": "signature did not verify", "fork": "expected one leaf, found 2", "bare": "leaf has no hash assertion",
        "other": "leaf hash differs", None: "unknown parent", "rootless": "expected one root, found 0"}
