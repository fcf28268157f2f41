import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlens import schemas
from provlens.functions import canonical as c
from provlens.functions import identifiers as ids
from provlens.operators import aggregates
from tests.conftest import canon, sha

# Published digests of canonical records.
GOLDEN = {
    '{"a":2,"b":1}': "d3626ac30a87e6f7a6428233b3c68299976865fa5508e4267c5415c76af7a772",
    '{"nested":{"a":"x","b":[1,2,3]},"top":true}': "c714449c010e88d0140bccf8164eb6820e343dd66df8f5a9a48a61f7f8689f4a",
    '[1,2,3,"four",null]': "1a75ce26e7a5740391899968fa5afa5e42f60e2b39290b22ac0b10a6ad75c7be",
    "{}": "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a",
    "[]": "4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945",
}
SCHEMA_HASHES = {
    "evidence": "1f9d805d58d29e9e2b8a3bd8dbd81c5430dfba7aec9b336adb702571025bac05",
    "sources": "617381c20880539a9283c112460e310dc7e92be2066e9b7b7d44018f182f4683",
    "provenance": "62e34b42370a7c9a5c7df8aa52e5100bad9f8246f4153758f78288097c8d7c0e",
    "provenance_steps": "d69877b26c7ca994e40f09890eba477f18bda48071f37e78f05419b2162ceaac",
    "authentication_assessments": "2d7384f43a897a2c8ec21fc9669a5835cc61e056c4f780c8cfdcb1c9c3b231df",
}
EMPTY_MANIFEST = "ef07ea2790e4622bae2fe590cce0898d45015da3c1cbc28ae46f55eaa77a0b82"


def test_golden_texts(spark):
    df = spark.createDataFrame([(k, v) for k, v in GOLDEN.items()], "text string, want string")
    rows = df.select("want", F.sha2(c.jcs_any("text"), 256).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_golden_struct(spark):
    df = spark.sql("SELECT true AS top, named_struct('b', array(1, 2, 3), 'a', 'x') AS nested")
    got = df.select(c.hash_object(df, ["top", "nested"]).alias("h")).first().h
    assert got == GOLDEN['{"nested":{"a":"x","b":[1,2,3]},"top":true}']


def test_empty_archive_manifest(spark):
    archives = spark.sql("SELECT 'x' AS archive_id, timestamp '2026-06-04 00:00:00' AS generated_at")
    rows = spark.createDataFrame([], "archive_id string, table string, row_hash string")
    blobs = spark.createDataFrame([], "archive_id string, hash string")
    out = aggregates.archive_manifest(rows, blobs, archives, "0.0.1").collect()
    assert [r.manifest_hash for r in out] == [EMPTY_MANIFEST]
    counts = {r.table: (r.row_count, r.schema_hash) for r in aggregates.table_counts(rows, archives).collect()}
    assert counts == {t: (0, h) for t, h in SCHEMA_HASHES.items()}


def test_control_characters(spark):
    text = "".join(map(chr, range(0x20))) + '"\\/\x7f é😀 \\u001F'
    df = spark.createDataFrame([(t,) for t in (text, "plain", "a\nb", "\x1f", "", None)], "s string")
    got = [r.c for r in df.select(c.canonical(F.col("s"), T.StringType()).alias("c")).collect()]
    assert got == [canon(t) for t in (text, "plain", "a\nb", "\x1f", "", None)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(
    st.text(st.characters(exclude_categories=["Cs"]), max_size=12),
    st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=4),
                    st.text(st.characters(exclude_categories=["Cs"]), max_size=6), max_size=4),
    st.one_of(st.none(), st.integers(-2**60, 2**60)), st.booleans()), min_size=1, max_size=25))
def test_matches_plain_python(spark, values):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)],
                               "i int, s string, m map<string,string>, n long, b boolean")
    text = c.canonical_struct({k: (F.col(k), df.schema[k].dataType) for k in ("s", "m", "n", "b")})
    for r in df.select("i", text.alias("t")).collect():
        s, m, n, b = values[r.i]
        assert r.t == canon({"s": s, "m": m, "n": n, "b": b})


@pytest.mark.parametrize("kind", ["double", "float", "decimal(10,2)", "binary"])
def test_refused_types(spark, kind):
    df = spark.sql(f"SELECT cast(null AS {kind}) AS x")
    with pytest.raises(TypeError):
        c.hash_object(df, ["x"])


def test_floats_have_no_canonical_form(spark):
    df = spark.createDataFrame([('{"a":1.5}',), ("not json",), ('{"b":[2,{"a":1}]}',)], "t string")
    assert [r.j for r in df.select(c.jcs_any("t").alias("j")).collect()] == [None, None, '{"b":[2,{"a":1}]}']


def test_key_order_beyond_bmp(spark):
    keys = ["￿", "\U0001f600", "a"]
    df = spark.createDataFrame([({k: "v" for k in keys},)], "m map<string,string>")
    got = df.select(c.canonical(F.col("m"), df.schema["m"].dataType).alias("t")).first().t
    assert got == canon({k: "v" for k in keys})


def test_identifiers(spark):
    h = "ab" * 32
    df = spark.createDataFrame([(h, "x/y.TIF", None), (f"sha256:{h}", ".md", None), (f"prov:evidence/sha256:{h}", "n", None),
                                (h.upper(), "a.pdf", "text/plain"), ("sha256:sha256:" + h, "q.txt", "application/pdf")],
                               "t string, path string, mime string")
    rows = df.select(ids.normalize_hash(F.col("t")).alias("h"),
                     ids.infer_kind(F.col("path"), F.col("mime")).alias("k")).collect()
    assert [r.h for r in rows] == [h, h, h, None, None]
    assert [r.k for r in rows] == ["still_image", "document_scan", "document_scan", "document_scan", "document_scan"]
    one = df.limit(1).select(ids.object_uri(F.lit(h)).alias("u"), ids.step_id(F.lit(h), F.lit(7)).alias("s"),
                             ids.ref_hash(F.lit("evidence"), F.lit(h)).alias("r"),
                             ids.key_fingerprint(F.lit("-----BEGIN PUBLIC KEY-----\naGVs\nbG8=\n-----END PUBLIC KEY-----"))
                             .alias("f")).first()
    assert one.u == f"objects/sha256/ab/{h[2:]}" and one.s == f"{h}__step00007"
    assert one.r == sha(f"evidence:{h}") and one.f == hashlib.sha256(b"hello").hexdigest()


def test_detect_kind_takes_the_first_that_fits(spark):
    keys = [k for _, need in schemas.KIND_KEYS for k in need]
    every = "{" + ",".join(f'"{k}":1' for k in dict.fromkeys(keys)) + "}"
    df = spark.createDataFrame([(every,), ('{"snapshot_hash":1}',), ("[1]",), ("broken",)], "t string")
    assert [r.k for r in df.select(ids.detect_kind(F.col("t")).alias("k")).collect()] == ["workspace", None, None, None]
