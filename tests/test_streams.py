"""Streams over several batches, out of order, repeated and restarted."""

import os
import pathlib
import random

import pytest

from provlens.operators import chains
from provlens.streaming import chain_state, streams
from tests.conftest import chain

ENTRY = ("archive_id string, pos long, seq long, prev_hash string, timestamp string, actor string, action string, "
         "target string, parameters map<string,string>, result string, schema_version string, entry_hash string")
NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def land(spark, folder, rows, schema, names, number):
    """One more file of arrivals."""
    before = set(pathlib.Path(folder).glob("*.parquet"))
    spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema).coalesce(1).write.mode("append").parquet(folder)
    for new in set(pathlib.Path(folder).glob("*.parquet")) - before:
        os.utime(new, (1_700_000_000 + number, 1_700_000_000 + number))


def tampered():
    rows = chain("a", 23) + chain("b", 6) + chain("c", 1)
    rows[4] = {**rows[4], "prev_hash": "f" * 64}
    rows[7] = {**rows[7], "actor": "someone"}
    rows[8] = {**rows[8], "entry_hash": "e" * 64}
    rows[15] = {**rows[15], "seq": 99}
    rows[23] = {**rows[23], "prev_hash": "1" * 64}
    return rows


def follow(spark, src, out, log, **more):
    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(src)
    with chain_state.keyed_state_store(spark):
        run = (chain_state.stream_verify_chain(stream, **more).writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start())
        run.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema("archive_id string, pos long, seq long, reason string").parquet(out).collect())


def table_failures(spark, rows):
    links = chains.chain_links(spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], ENTRY))
    return sorted(tuple(r) for r in links.select("archive_id", "pos", "seq", chains.link_failures().alias("reason"))
                  .filter("reason IS NOT NULL").collect())


@pytest.mark.parametrize("order", ["reverse", "shuffled"])
def test_entries_in_any_order_give_the_failures_of_the_table(spark, tmp_path, order):
    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    rows = tampered()
    pieces = [rows[i:i + 6] for i in range(0, len(rows), 6)][::-1]
    if order == "shuffled":
        mixed = rows + rows[3:9]  # some come twice
        random.Random(1).shuffle(mixed)
        pieces = [mixed[i:i + 8] for i in range(0, len(mixed), 8)]
    for i, part in enumerate(pieces[:2]):
        land(spark, src, part, ENTRY, NAMES, i)
    early = follow(spark, src, out, log, span=5)
    for i, part in enumerate(pieces[2:], 2):  # goes on from the checkpoint
        land(spark, src, part, ENTRY, NAMES, i)
    got = follow(spark, src, out, log, span=5)
    assert got == table_failures(spark, rows) and len(got) == 7 and set(early) < set(got)
    land(spark, src, rows[:6], ENTRY, NAMES, 50)  # repeats of judged entries are no failures
    assert follow(spark, src, out, log, span=5) == got


def test_a_gap_is_given_up_after_a_while(spark, tmp_path):
    import time

    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    rows = chain("a", 9)
    land(spark, src, rows[:3] + rows[5:], ENTRY, NAMES, 0)
    stream = spark.readStream.schema(ENTRY).parquet(src)
    with chain_state.keyed_state_store(spark):
        run = (chain_state.stream_verify_chain(stream, patience_ms=1).writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", log).outputMode("append").trigger(processingTime="200 milliseconds").start())
        got, until = [], time.time() + 60
        while not got and time.time() < until and run.isActive:
            time.sleep(1)
            if os.path.isdir(f"{out}/_spark_metadata"):
                got = spark.read.schema("archive_id string, pos long, seq long, reason string").parquet(out).collect()
        run.stop()
    assert [tuple(r) for r in got] == [("a", 5, 5, "no entry before position 5 came.")]


def test_counts_are_merged_while_old_windows_leave_the_state(spark, tmp_path):
    from datetime import datetime, timedelta

    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    start, want = datetime(2026, 1, 1), {}
    rng = random.Random(3)
    for day in range(8):
        rows = [{"timestamp": start + timedelta(days=day, minutes=rng.randrange(1440)), "action": rng.choice("ab")} for _ in range(20)]
        if day:  # still open: the watermark follows by two days
            rows += [{"timestamp": start + timedelta(days=day - 1, hours=1), "action": "c"}]
        for r in rows:
            k = (r["timestamp"].date(), r["action"])
            want[k] = want.get(k, 0) + 1
        land(spark, src, rows, "timestamp timestamp, action string", ["timestamp", "action"], day)
    stream = spark.readStream.schema("timestamp timestamp, action string").option("maxFilesPerTrigger", 1).parquet(src)
    run = (streams.stream_action_counts(stream, watermark="2 days").writeStream.foreachBatch(streams.merge_counts(out))
           .outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).start())
    run.awaitTermination()
    got = streams.merged_counts(spark, out).collect()
    assert {(r.window_start.date(), r.action): r["count"] for r in got} == want and len(got) == len(want)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 15
    batch = spark.createDataFrame([(start, start + timedelta(days=1), "a", 1000)], "window_start timestamp, window_end timestamp, action string, count long")
    for _ in range(2):  # a repeated batch changes nothing more
        streams.merge_counts(out)(batch, 900)
    again = {(r.window_start.date(), r.action): r["count"] for r in streams.merged_counts(spark, out).collect()}
    assert again == {**want, (start.date(), "a"): 1000}
