"""Chain checks over a stream whose entries come in any order, with state per part of a log."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provlens import schemas
from provlens.functions import canonical as canon
from provlens.operators import chains

LINK = ["seq", "prev_hash", "entry_hash", "computed_hash"]
_JUDGED = ("archive_id string, pos long, seq long, prev_hash string, entry_hash string, computed_hash string, "
           "expected_seq long, expected_prev_hash string, missing boolean")


@contextmanager
def keyed_state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which keyed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class ChainFollower(StatefulProcessor):
    """One part of a log: the entry that the next one must link to, and entries that wait for theirs.

    Both are one list, so a batch reads and writes the state of a part in one call each: the row
    that doesn't wait holds the place that comes next with the sequence number and hash it must
    follow, the others are entries that came too early. A part is done when its last place is
    judged; of the state only the place then stays, so that repeats are known as such.
    """

    def __init__(self, span: int, patience_ms: int | None) -> None:
        self.span, self.patience_ms = span, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.part = handle.getListState(
            "part", "pos long, seq long, prev_hash string, entry_hash string, computed_hash string, waits boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        archive, part = key
        came: dict[int, tuple] = {}
        for r in rows:
            came.setdefault(r["pos"], tuple(r[c] for c in LINK))
        yield from self._judged(archive, part, came, timerValues, skip=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        archive, part = key
        yield from self._judged(archive, part, {}, timerValues, skip=True)

    def _judged(self, archive: str, part: int, came: dict[int, tuple], timers: Any, skip: bool) -> Iterator[Row]:
        begin, end = part * self.span, (part + 1) * self.span
        known, held = None, {}
        for pos, *entry, waits in self.part.get():
            if waits:
                held[pos] = tuple(entry)
            else:
                known = (pos, entry[0], entry[2])
        new = known is None
        if known is None:
            known = (0, -1, schemas.ZERO_HASH) if part == 0 else (begin - 1, None, None)
        place, seq, link = known
        came = {p: v for p, v in came.items() if p >= place and p not in held}
        out = []
        open_entries = {**held, **came}
        if skip and open_entries and place not in open_entries:
            # What was waited for is given up; the chain goes on at the first entry that is there.
            place = min(open_entries)
            first = open_entries[place]
            out.append((archive, place, *first, None, None, True))
            seq, link, place = first[0], first[2], place + 1
        while place in open_entries and place < end:
            own_seq, prev, own, computed = open_entries[place]
            if place >= begin:  # the one before a part's first is judged in its own part
                expected_seq, expected = (0 if place == 0 or seq is None else seq + 1), link
                if own_seq != expected_seq or prev != expected or own != computed:
                    out.append((archive, place, own_seq, prev, own, computed, expected_seq, expected, False))
            seq, link, place = own_seq, own, place + 1
        if new or (place, seq, link) != known:
            waiting = [(p, *v, True) for p, v in open_entries.items() if p >= place]
            self.part.put([(place, seq, None, link, None, False), *waiting])
        elif came:
            self.part.appendList([(p, *v, True) for p, v in came.items()])
        if self.patience_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if any(p >= place for p in open_entries):
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience_ms)
        names = [x.split()[0] for x in _JUDGED.split(", ")]
        for found in out:
            yield Row(**dict(zip(names, found)))

    def close(self) -> None:
        pass


def stream_verify_chain(entries: DataFrame, patience_ms: int | None = None, span: int = chains.SPAN) -> DataFrame:
    """Failures of growing logs as a stream: ``archive_id, pos, seq, reason``, each as soon as it is sure.

    ``entries`` has the columns of an audit log with its dense ``pos``. Entries may come in any
    order and more than once; of repeats the first that came counts. State is kept per archive and
    ``span`` places, so a log that holds most of all entries is followed by many tasks; the last
    entry of a span also goes to the next one. An entry waits until the one before it has come,
    which gives the failures of the table. With ``patience_ms`` it waits so long at most: then the
    gap is a failure of its own and the chain goes on behind it. Such a stream waits for clock
    time, so it runs with a trigger of its own pace; ``availableNow`` would never find it done.

    Start the stream inside :func:`keyed_state_store`, in append mode.
    """
    place = F.floor(F.col("pos") / span).cast("long")
    parts = F.when((F.col("pos") + 1) % span == 0, F.array(place, place + 1)).otherwise(F.array(place))
    narrow = entries.select("archive_id", "pos", "seq", "prev_hash", "entry_hash", canon.entry_hash(entries).alias("computed_hash"),
                            F.explode(parts).alias("part"))
    judged = narrow.groupBy("archive_id", "part").transformWithState(
        ChainFollower(span, patience_ms), _JUDGED, "append", "None" if patience_ms is None else "ProcessingTime")
    reason = F.when(F.col("missing"), F.concat(F.lit("no entry before position "), F.col("pos").cast("string"), F.lit(" came."))).otherwise(
        chains.link_failures())
    return judged.select("archive_id", "pos", "seq", reason.alias("reason"))
