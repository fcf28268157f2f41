"""Single files of archives: every name, sliced listing, pushed filters, digests, writing."""

import hashlib
import io
from contextlib import redirect_stdout

import pyarrow as pa
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from provlens.plans import verify
from provlens.sources import archive_files, readers, writers


def frame(spark, rows):
    return spark.createDataFrame(rows, "archive_id string, path string, content string")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("files") / "with space é")
    rows = [(a, f"workspaces/{n}.json", body) for a in ("one", "two", "archive with é") for n, body in (
        ("plain", "{}"), ("_draft", '{"x": 1}'), (".hidden", "[]"), ("empty", ""), ("sub/deep", "{}"), ("a=b%20c", "{}"))]
    writers.write_files(frame(spark, rows), base)
    return base


def listed(df):
    return sorted((r.archive_id, r.path) for r in df.collect())


@pytest.mark.parametrize("slices", [1, 3])
def test_every_name_is_listed_once(spark, root, slices):
    names = ["workspaces/" + n for n in ("plain.json", "_draft.json", ".hidden.json", "empty.json", "a=b%20c.json")]
    archives = ["one", "two", "archive with é"]
    assert listed(archive_files.read_files(spark, root, "workspaces/*.json", slices=slices)) == sorted((a, n) for a in archives for n in names)
    deep = archive_files.read_files(spark, root, "**/*.json", slices=slices)
    assert listed(deep) == sorted((a, n) for a in archives for n in [*names, "workspaces/sub/deep.json"])
    assert listed(archive_files.read_files(spark, root, "workspaces/plain.json", slices=slices)) == sorted((a, "workspaces/plain.json") for a in archives)
    assert listed(archive_files.read_files(spark, root, "nowhere/*", slices=slices)) == []
    assert listed(archive_files.read_files(spark, root + "-none", "*", slices=slices)) == []


def test_filters_choose_folders(spark, root):
    df = archive_files.read_files(spark, root, "workspaces/*.json").filter("archive_id IN ('two', 'nine') AND size_bytes > 1")
    assert {r.archive_id for r in df.collect()} == {"two"} and df.rdd.getNumPartitions() == archive_files.SLICES
    one = archive_files.read_files(spark, root, "workspaces/*.json").filter("archive_id = 'one'")
    with io.StringIO() as out, redirect_stdout(out):
        one.explain("formatted")
        plan = out.getvalue()
    assert "Filter" not in plan.split("(1)")[0] and one.count() == 5


def test_contents_and_digests(spark, root):
    read = archive_files.read_files(spark, root, "workspaces/*.json", content="bytes")
    assert {bytes(r.content) for r in read.collect()} == {b"{}", b'{"x": 1}', b"[]", b""}
    digest = archive_files.read_files(spark, root, "workspaces/*.json", content="digest")
    assert {r.sha256 for r in digest.collect()} == {hashlib.sha256(x).hexdigest() for x in (b"{}", b'{"x": 1}', b"[]", b"")}


def test_files_that_cannot_be_read_are_rows(spark, root, tmp_path, monkeypatch):
    writers.write_files(frame(spark, [("a", "x", "12345"), ("a", "y", None)]), str(tmp_path / "r"))
    monkeypatch.setattr(archive_files, "LARGEST", 3)
    reader = archive_files.ArchiveFilesReader({"root": str(tmp_path / "r"), "pattern": "*", "content": "bytes", "slices": "1"})
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert {(r["path"], r["size_bytes"], r["content"], r["error"]) for r in rows} == {("x", 5, None, "too_large"), ("y", 0, b"", None)}
    assert reader._read(archive_files.opened("/")[0], archive_files.fs.FileInfo("/no/such/file", size=1))[2] == "FileNotFoundError"


def test_a_later_file_replaces_an_earlier_one(spark, tmp_path):
    base = str(tmp_path / "r")
    for body in ("first", "second"):
        writers.write_files(frame(spark, [("a", "x/y.txt", body)]), base)
    assert [bytes(r.content) for r in archive_files.read_files(spark, base, "x/*", content="bytes").collect()] == [b"second"]
    for path in ("../out", "/abs", "x//y", ""):
        with pytest.raises(Exception, match="no file name"):
            writers.write_files(frame(spark, [("a", path, "z")]), base)


def test_rows_and_blobs_written_as_files_come_back(spark, tmp_path):
    base = str(tmp_path / "r")
    payload = '{"a":"é"}'
    rows = spark.createDataFrame([("one", "sources", "s1", "h1", payload), ("two", "sources", "s1", "h2", None)],
                                 "archive_id string, table string, row_id string, row_hash string, payload string")
    writers.write_rows(rows, base)
    assert sorted(map(tuple, readers.scan_rows(spark, base, "sources").select("archive_id", "row_id", "row_hash", "payload").collect())) == [
        ("one", "s1", "h1", payload), ("two", "s1", "h2", None)]
    good, bad = hashlib.sha256(b"x").hexdigest(), hashlib.sha256(b"y").hexdigest()
    blobs = [("one", f"objects/sha256/{h[:2]}/{h[2:]}", "x") for h in (good, bad)] + [("one", "objects/sha256/ab/short", "x")]
    writers.write_files(frame(spark, blobs), base)
    for options in ({"content": True}, {"digest": True}):
        checked = verify.blob_integrity(readers.scan_blobs(spark, base, **options))
        assert {(r.hash, r.ok) for r in checked.collect()} == {(good, True), (bad, False)}


@pytest.fixture()
def stored(tmp_path):
    """Rows as files: of many names, and some that hold no single row."""
    for archive in ("one", "two", ".three", "archive_id=two", "archive_id=a%20b", "é +"):
        folder = tmp_path / "ro ot%20é" / archive / "tables" / "evidence"
        (folder / "deeper").mkdir(parents=True)

        def put(name, n=1, folder=folder, **columns):
            columns = columns or {"row_hash": ["h-" + name] * n, "payload_jcs": [b'{"a":1}'] * n}
            parquet.write_table(pa.table(columns), folder / name, compression="zstd")

        for name in ("a.parquet", "b c%20.parquet", "d é+#&.parquet", "x=1.parquet", "_y=1.parquet", "_hidden.parquet", ".dot.parquet",
                     "z._COPYING_", "other.name", "second.name", "deeper/in.parquet"):
            put(name)
        if archive != "archive_id=two":
            put("e.parquet")
        put("many.parquet", n=3)
        put("none.parquet", n=0, row_hash=pa.array([], pa.string()), payload_jcs=pa.array([], pa.binary()))
        put("text.parquet", row_hash=pa.array([b"h"], pa.binary()), payload_jcs=pa.array(["{}"], pa.large_string()))
        put("capital.parquet", ROW_HASH=["h"], Payload_JCS=[b"{}"], more=[1])
        put("nulls.parquet", row_hash=pa.array([None], pa.string()), payload_jcs=pa.array([None], pa.binary()))
        put("half.parquet", row_hash=["h"])
        put("kind.parquet", row_hash=[1], payload_jcs=[b"{}"])
        put("twice.parquet", row_hash=["h"], ROW_HASH=["i"], payload_jcs=[b"{}"])
        whole = (folder / "a.parquet").read_bytes()
        for name, body in (("empty", b""), ("cut", whole[:-30]), ("bad", b"no parquet"), ("torn", b"PAR1" + b"\xff" * 60 + whole[64:])):
            (folder / f"{name}.parquet").write_bytes(body)
    return str(tmp_path / "ro ot%20é")


def test_stored_rows_are_listed_and_read_in_tasks(spark, stored, monkeypatch):
    rows = readers.scan_rows(spark, stored, "evidence")
    assert rows.inputFiles() == []  # the driver knows no file
    got = sorted(map(tuple, rows.collect()), key=str)
    assert len(got) > 40 and {r[0] for r in got} == {"one", "two", ".three", "a%20b", "é +"}
    assert sorted(map(tuple, readers.scan_rows(spark, f"file://{stored}/", "evidence").collect()), key=str) == got
    monkeypatch.setattr(readers, "can_open", lambda root: False)  # by Spark's reader, as where pyarrow.fs cannot read
    plain = readers.scan_rows(spark, stored, "evidence")
    assert len(plain.inputFiles()) > 60 and sorted(map(tuple, plain.collect()), key=str) == got


def test_a_table_that_no_archive_has_is_an_error(spark, stored):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.scan_rows(spark, stored, "nothing")


def test_hidden_artifacts_are_read(spark, root):
    found = {(r.archive_id, r.artifact_name): r.decode_error for r in readers.scan_artifacts(spark, root, "workspace").collect()}
    assert {n for _, n in found} == {"plain", "_draft", ".hidden", "empty", "a=b%20c"} and len(found) == 15
    assert found[("one", "_draft")] == "hidden_file" and found[("one", "empty")] == "ValueError"
    texts = readers.scan_artifact_texts(spark, root).filter(F.col("archive_id") == "two").collect()
    assert len(texts) == 5 and {r.text for r in texts} == {"{}", '{"x": 1}', "[]", ""}
