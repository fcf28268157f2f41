"""A cross-section of the registered queries against their SQL; tools/check.py runs them all."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = ["src_3_upsert", "flt_5_validate_rows_evidence", "join_4_assess", "join_6_coverage", "agg_3_archive_manifest",
         "agg_6_kind_counts", "win_2_verify_chain", "win_3_verify_chain_all", "set_1_snapshot_diff_hash",
         "set_3_compare_archives", "set_5_manifest_diff", "gr_2_graph_integrity", "gr_13_build_justification",
         "gr_16_derived_integrity", "gr_22_media_chain_status"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rel = duck.sql(entry.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(rel.columns, rel.fetchall())


def test_every_query_is_registered_and_named_for_the_inventory():
    names = set(entry.queries())
    assert names >= set(entry.oracle_sql()) and names >= set(NAMES)
    expected = ([f"flt_{i}" for i in range(1, 10)] + [f"join_{i}" for i in range(1, 17)]
                + [f"agg_{i}" for i in range(1, 18)] + [f"win_{i}" for i in range(1, 10)]
                + [f"ord_{i}" for i in range(1, 5)] + [f"set_{i}" for i in range(1, 9)]
                + [f"fn_{i}" for i in range(1, 18)] + [f"gr_{i}" for i in range(1, 28)]
                + [f"str_{i}" for i in range(1, 4)] + ["src_1", "src_2", "src_3", "src_5", "src_6", "src_10", "src_11", "src_12"])
    assert [e for e in expected if not any(n.startswith(e + "_") for n in names)] == []
