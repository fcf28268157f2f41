"""Conversation repair against every possible edit, and over cut-up long conversations."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

from provlens.llm import repair


@lru_cache(None)
def every_repair(codes):
    """(cost, audit, turns) of each edit with at most two inserts in a row; turns are (initial, number or None)."""
    out = []

    def go(i, cost, audit, turns):
        if cost > 3 * len(codes):  # all deleted
            return
        if i == len(codes):
            out.append((cost, audit, turns))
        if len(audit) - len(audit.rstrip("I")) < 2:
            for s in "ua":
                go(i, cost + 2, audit + "I", turns + [(s, None)])
        if i < len(codes):
            c = codes[i]
            go(i + 1, cost + 3, audit + "D", turns)
            if c != "x":
                more = 1 if c.isupper() else 0
                go(i + 1, cost + more, audit + "K", turns + [(c.lower(), i)])
                for s in "ua":
                    go(i + 1, cost + more + 2, audit + "R", turns + [(s, i)])

    go(0, 0, "", [])
    return [x for x in out if re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in x[2]))]


def plain(rows):
    """The report of one conversation's rows (turn, role, text), by brute force."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    counts, seen, codes = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), ""
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        code = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, made = min(every_repair(codes), key=lambda x: x[:2])
    names = {"u": "user", "a": "assistant", "s": "system"}
    ops, lines, at = audit.replace("D", ""), [], 0
    for op, (s, i) in zip(ops, made):
        lines.append((rows[i][1] if op == "K" else names[s]) + ":" + (rows[i][2] if i is not None else ""))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(0, 3)):
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), rng.choice(["user", "assistant", "assistant", "system", "tool", "", "Ärger"]),
                         rng.choice(["a.", "b!", "c", "d. \n", "", " \t", "é?", "a.", "no end \x85"])))
    rows += [(None, 0, "user", "q?"), (None, None, None, None), (None, 1, "assistant", "x"), (900, 0, "user", "q?"), (900, 0, "user", "q?"),
             (901, None, "user", None), (902, -3, "system", "s."), (902, 4, "user", "w" * 100000 + ".")]
    return rows


def collected(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[n] for n in names[1:]) for r in df.select(names).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, "k") for r in rows],
                                 "conv_id long, turn long, role string, text string, fault string, position int, key string").repartition(3)


def test_reports_equal_every_possible_edit(spark):
    rows = conversations()
    got = collected(repair.reports(frame(spark, rows), frame(spark, rows + [(7777, 0, "user", "dropped before")])))
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {**{c: plain(v) for c, v in by.items()}, 7777: nothing}


def test_damage_follows_the_key(spark):
    rows = conversations()
    got = sorted(map(tuple, repair.damaged(frame(spark, rows)).collect()), key=str)
    wanted = []
    for c, t, r, x in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x
        wanted += [(c, t, "user" if f == 4 else r, x)] * (0 if f == 0 else 2 if f == 3 else 1)
    assert got == sorted(wanted, key=str)


def test_long_conversations_in_parts_equal_one_walk(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 3)
    monkeypatch.setattr(repair, "FAN", 2)
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", f"{t}!", f"{t} cut", ""]))
            for c in range(6) for t in range([1, 3, 7, 12, 40, 101][c])]
    got = collected(repair.reports(frame(spark, rows), frame(spark, rows)))
    for c in range(6):
        seen, codes, mine = set(), "", [(r, x) for k, _, r, x in rows if k == c]
        for r, x in mine:
            code = r[0] if r[0] in "sua" else "o"
            codes += "x" if not x or (r, x) in seen else code if x[-1] in ".!?" else code.upper()
            seen.add((r, x))
        ends = [(cost + 2 * len(repair.LAST[t]), audit, t) for t, (cost, audit) in repair.parsed(codes, "0").items()]
        cost, audit, top = min(ends)
        done = repair.replayed(codes, audit, "0")
        lines = [x for (before, op, role, _), (r, t) in zip(done, mine)
                 for x in [*([before] if before else []), *([f"{r if op == 'K' else role}:{t}"] if op != "D" else [])]]
        lines += [repair.NAMES[s] + ":" for s in repair.LAST[top]]
        assert got[c][5:] == (cost, audit + "I" * len(repair.LAST[top]), hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_segments_put_together_equal_whole_parses():
    rng = random.Random(2)
    for _ in range(200):
        codes = "".join(rng.choice("suaSUAxo") for _ in range(rng.randint(2, 12)))
        cut = rng.randint(1, len(codes) - 1)
        a, b = (repair._ways(list(repair.segment_ways(x, w))) for x, w in ((codes[:cut], True), (codes[cut:], False)))
        ways, between = repair.joined_ways(a, b)
        whole = repair.parsed(codes, "0")
        for q, top in enumerate(repair.TOPS):
            if top not in whole:
                assert ways[0][q] == repair.NONE
                continue
            mid = repair.TOPS[between[0][q]]
            assert whole[top] == (ways[0][q][0], repair.parsed(codes[:cut], "0")[mid][1] + repair.parsed(codes[cut:], mid)[top][1])


def test_every_short_conversation_by_every_edit():
    for n in range(4):
        for codes in itertools.product("suaUxo", repeat=n):
            ends = [(c + 2 * len(repair.LAST[t]), a + "I" * len(repair.LAST[t])) for t, (c, a) in repair.parsed("".join(codes), "0").items()]
            assert min(ends) == min(x[:2] for x in every_repair(codes))


def test_no_conversations(spark):
    empty = frame(spark, [(1, 1, "user", "x")]).limit(0)
    assert repair.damaged_and_repaired(empty).collect() == []
