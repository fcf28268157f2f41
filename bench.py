"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from provlens.operators import chains  # noqa: E402
from provlens.session import get_session, landed  # noqa: E402
from provlens.workload.queries import registered  # noqa: E402
from provlens.workload.world import World  # noqa: E402

HEADLINE = [
    "join_4_assess", "win_2_verify_chain", "win_6_append_chain", "agg_3_archive_manifest", "gr_6_impact",
    "set_3_compare_archives", "gr_16_derived_integrity", "win_8_dedupe_first", "join_6_coverage",
    "gr_11_build_timeline", "gr_22_media_chain_status", "gr_21_proof_verdicts", "fn_4_self_hash",
    "agg_13_header_consensus",
]
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def timed(run) -> float:
    spent = []
    for _ in range(REPEATS + 1):  # the first run warms up
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        spent.append(time.perf_counter() - start)
    return round(statistics.median(spent[1:]), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    times = {}
    for name in HEADLINE:
        if not only or name in only:
            times[name] = timed(lambda name=name: registered()[name](spark, folder))
    if not only or "verify_one_long_chain" in only:
        # All events as one log: the worst case for anything that sorts per archive.
        events = World(spark, folder).events.withColumn("archive_id", F.lit("all"))
        log = landed(chains.append_chain(None, events.drop("value"), ["ts", "event_id"]))
        times["verify_one_long_chain"] = timed(lambda: chains.verify_chain(log))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
