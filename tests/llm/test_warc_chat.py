"""WARC archives and preference pairs."""

import hashlib

import pytest

from provlens.llm import chat, warc

LONG, OTHER = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n" + "x" * 120, "y" * 100
PAGES = [(5, "http://a/ b\r\nX: 1", LONG), (3, "http://a", LONG), (9, None, LONG), (4, "http://c", OTHER), (None, "http://n", OTHER),
         (1, "http://d", "short"), (2, "http://e", "short"), (6, "", None), (7, "http://f", ""), (8, "http://g", OTHER),
         (8, "http://g2", OTHER), (10, "http://h", "y" * 99), (11, "http://i", "y" * 99), (12, "http://j", "z" * 300000)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "extra", 1) for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, payload_bytes int").repartition(3)


def test_archive_round_trip(pages):
    rows = warc.archive(pages).collect()
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    first = {LONG: 3, OTHER: 4, "z" * 300000: 12}
    wanted = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        revisit = h in first and i is not None and i != first[h]
        wanted.append((i or 0, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    assert got == sorted(wanted, key=str) and all(r.resolves for r in rows)


def test_records_hold_payloads_and_fresh_headers(spark, pages, tmp_path):
    warc.write(pages, str(tmp_path / "w"))
    rows = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w")).collect() if r.page_id not in (8, None)}
    html = {i: h or "" for i, _, h in PAGES}
    for i, r in rows.items():
        assert (bytes(r.payload).decode() == html[i] and r.stored_digest == r.payload_digest) if r.record_type == "response" else r.payload is None
    assert rows[5].url == "http://a/%20b%20%20X:%201" and rows[6].url == "urn:page:6"


def test_a_cut_archive_is_noticed():
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.parse(record))


def test_archives_with_a_member_per_record_are_read_whole(spark, tmp_path):
    import gzip

    def record(kind, n, payload):
        http = b"HTTP/1.1 200 OK\r\ncontent-length: %d\r\n\r\n" % len(payload) + payload
        return (b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Target-URI: http://x/%d\r\nContent-Length: %d\r\n\r\n" % (kind, n, len(http))) + http + b"\r\n\r\n"

    records = [record(b"warcinfo", 0, b"about")] + [record(b"response", n, b"p" * n * 1000) for n in range(1, 90)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.url, r.payload_bytes, len(r.payload), r.page_id, r.payload_digest) for r in rows) == sorted(
        (f"http://x/{n}", n * 1000, n * 1000, None, None) for n in range(1, 90))
    assert warc.expanded(gzip.compress(b"one") + gzip.compress(b"") + gzip.compress(b"two"), 7) == b"onetwo"
    with pytest.raises(ValueError):
        warc.expanded(gzip.compress(b"one" * 100)[:-9])


def test_no_pages(pages):
    assert warc.archive(pages.limit(0)).collect() == []


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "pair_id long, turn long, role string, text string, part string")


def test_longest_common_prefix_comes_once(spark):
    chosen = turns(spark, [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (1, 3, "user", "thanks"),
                           (2, 0, "user", "same"), (3, 0, "user", "only here"), (4, None, "user", None), (4, 1, "assistant", "<|im_end|>"),
                           (5, 0, "user", "a"), (5, 0, "user", "a"), (5, 1, "assistant", ""), (6, 0, "user", "x"), (6, 1, "user", "y")])
    rejected = turns(spark, [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", "thanks"),
                             (2, 0, "user", "same"), (4, None, "user", None), (5, 0, "user", "a"), (6, 0, "user", "z"), (6, 1, "user", "y")])
    got = {}
    for r in chat.preference_segments(chosen, rejected).collect():
        got.setdefault((r.pair_id, r.part), []).append((r.turn, r.role, r.loss))
    got = {k: sorted(v, key=str) for k, v in got.items()}
    assert got == {
        (1, "prompt"): [(0, "system", False), (1, "user", False)],
        (1, "chosen"): [(2, "assistant", True), (3, "user", False)], (1, "rejected"): [(2, "assistant", True), (3, "user", False)],
        (2, "prompt"): [(0, "user", False)], (3, "chosen"): [(0, "user", False)],
        (4, "prompt"): [(None, "user", False)], (4, "chosen"): [(1, "assistant", True)],
        (5, "prompt"): [(0, "user", False)], (5, "chosen"): [(1, "assistant", True)],
        (6, "chosen"): [(0, "user", False), (1, "user", False)], (6, "rejected"): [(0, "user", False), (1, "user", False)]}
    whole = {r.pair_id: r for r in chat.assembled(chat.preference_segments(chosen, rejected)).collect()}
    assert whole[1].prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert whole[1].chosen == "<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nthanks<|im_end|>\n"
    (span,) = whole[1].chosen_spans
    assert whole[1].chosen[span.start:span.start + span.length] == "<|im_start|>assistant\ngood<|im_end|>\n"
    assert whole[4].chosen == "<|im_start|>assistant\n<| im_end|><|im_end|>\n" and whole[2].chosen == ""


def test_one_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3000)]
    other = rows[:2000] + [(1, i, r, t + "!") for _, i, r, t in rows[2000:]]
    out = chat.preference_segments(turns(spark, rows), turns(spark, other)).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in out} == {"prompt": 2000, "chosen": 1000, "rejected": 1000}


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preferences(df).collect() == []
