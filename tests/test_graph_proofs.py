import random

import pytest

from provlens import schemas
from provlens.operators import graph, proofs

EDGE = "archive_id string, kind string, src_kind string, src_id string, dst_kind string, dst_id string"


def edges(spark, pairs):
    return spark.createDataFrame([("x", "e", "n", a, "n", b) for a, b in pairs], EDGE)


def nodes(spark, names):
    return spark.createDataFrame([("x", "n", a) for a in names], "archive_id string, kind string, id string")


def brute(pairs, root, incoming):
    step = {}
    for a, b in pairs:
        step.setdefault(b if incoming else a, set()).add(a if incoming else b)
    seen, frontier, d = {}, {root}, 0
    while frontier:
        d += 1
        frontier = {t for f in frontier for t in step.get(f, ()) if t != root and t not in seen}
        seen |= {t: d for t in frontier}
    return seen


def test_cycle_and_diamond(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("d", "e"), ("e", "c"), ("f", "f")]
    names = "abcdef"
    for incoming, fn in ((True, graph.dependents_closure), (False, graph.dependency_closure)):
        got = {}
        for r in fn(edges(spark, pairs), nodes(spark, names)).collect():
            got.setdefault(r.root_id, {})[r.node_id] = r.distance
        assert got == {n: b for n in names if (b := brute(pairs, n, incoming))}


def test_random_graphs_keep_least_distance(spark):
    rnd = random.Random(5)
    pairs = list({(f"v{rnd.randrange(14)}", f"v{rnd.randrange(14)}") for _ in range(30)})
    names = [f"v{i}" for i in range(14)]
    got = {}
    for r in graph.impact(nodes(spark, names), edges(spark, pairs), nodes(spark, names)).collect():
        got.setdefault(r.root_id, {})[r.node_id] = r.distance
    assert got == {n: b for n in names if (b := brute(pairs, n, True))}


def test_many_roots_share_bits(spark):
    rnd = random.Random(6)
    pairs = list({(f"v{rnd.randrange(150)}", f"v{rnd.randrange(150)}") for _ in range(220)})
    names = [f"v{i}" for i in range(150)]
    for incoming, fn in ((True, graph.dependents_closure), (False, graph.dependency_closure)):
        got = {}
        for r in fn(edges(spark, pairs), nodes(spark, names)).collect():
            assert r.node_id not in got.setdefault(r.root_id, {})
            got[r.root_id][r.node_id] = r.distance
        assert got == {n: b for n in names if (b := brute(pairs, n, incoming))}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("closure_")]


def test_kinds_that_dont_lead_back_take_joins_only(spark):
    # Two ways of different length lead from a to c; the shorter one counts.
    rows = [("x", "e", "a", "1", "b", "1"), ("x", "e", "a", "2", "b", "1"), ("x", "e", "b", "1", "c", "1"), ("x", "e", "a", "1", "c", "1"),
            ("x", "e", "b", "2", "c", "1"), ("y", "e", "b", "1", "c", "9")]
    kinds = graph._kind_steps(spark.createDataFrame(rows, EDGE), "src", "dst")
    assert graph._stages(kinds) == (2, False) and graph._stages({"a": {"b"}, "b": {"c"}}) == (2, True)
    assert graph._stages({"a": {"b"}, "b": {"a"}}) is None and graph._stages({"a": {"a"}}) is None and graph._stages({}) == (0, True)
    roots = spark.createDataFrame([("x", "a", "1"), ("x", "a", "2"), ("y", "b", "1"), ("z", "b", "1")], "archive_id string, kind string, id string")
    got = {(r.archive_id, r.root_id, r.node_kind, r.node_id, r.distance)
           for r in graph.dependency_closure(spark.createDataFrame(rows, EDGE), roots).collect()}
    assert got == {("x", "1", "b", "1", 1), ("x", "1", "c", "1", 1), ("x", "2", "b", "1", 1), ("x", "2", "c", "1", 2), ("y", "1", "c", "9", 1)}
    assert graph.dependency_closure(spark.createDataFrame([], EDGE), roots).collect() == []


def test_unknown_root_is_told_apart(spark):
    known = graph.known_roots(nodes(spark, ["a"]), nodes(spark, ["a", "zz"])).collect()
    assert {r.id: r.exists for r in known} == {"a": True, "zz": False}
    assert graph.impact(nodes(spark, ["a"]), edges(spark, [("b", "zz")]), nodes(spark, ["zz"])).count() == 0


def landed(spark, specs):
    """``specs``: proof id -> (premises, steps (id, rule, inputs, output), claims (id, by), conclusion)."""
    rows = []
    for pid, (prem, steps, claims, concl) in specs.items():
        rows.append(("x", "prov.justification.inference-proof.v1", "1", pid, "j", "0" * 64,
                     [(p, "t", ["a" * 64], "observation") for p in prem],
                     [(i, r, ins, out, "t") for i, r, ins, out in steps], [(c, "t", by) for c, by in claims], concl, "h"))
    schema = "archive_id string, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in schemas.ARTIFACTS["inference_proof"][0].fields)
    return proofs.explode_proofs(spark.createDataFrame(rows, schema))


SPECS = {
    "good": (["p", "q"], [("i", "modus_ponens", ["p", "q"], "c")], [("c", "i")], "c"),
    "premise": (["p"], [], [], "p"),
    "arity": (["p"], [("i", "modus_ponens", ["p"], "c")], [("c", "i")], "c"),
    "vocabulary": (["p"], [("i", "guess", ["zz"], "yy")], [], "p"),
    "inputs": (["p"], [("i", "abduction_to_best_explanation", ["p", "zz"], "c")], [("c", "i")], "c"),
    "output": (["p"], [("i", "abduction_to_best_explanation", ["p"], "yy")], [], "p"),
    "by": (["p"], [("i", "abduction_to_best_explanation", ["p"], "c"), ("k", "abduction_to_best_explanation", ["p"], "d")],
           [("c", "k"), ("d", "k")], "c"),
    "orphan": (["p"], [], [("c", "none")], "p"),
    "conclusion": (["p"], [], [], "zz"),
    "cycle": (["p"], [("i", "conjunction_intro", ["p", "d"], "c"), ("k", "abduction_to_best_explanation", ["c"], "d")],
              [("c", "i"), ("d", "k")], "d"),
    "island": (["p"], [("i", "abduction_to_best_explanation", ["c"], "d"), ("k", "abduction_to_best_explanation", ["d"], "c")],
               [("c", "k"), ("d", "i")], "d"),
}


def test_proof_errors_and_verdicts(spark):
    p = landed(spark, SPECS)
    errors = {(r.proof_id, r.subject, r.error) for r in proofs.proof_errors(p).collect()}
    assert errors == {
        ("arity", "i", "too_few_inputs"), ("vocabulary", "i", "unknown_rule"), ("inputs", "i", "unknown_input:zz"),
        ("output", "i", "undeclared_output:yy"), ("by", "i", "inferred_by_disagrees:k"),
        ("orphan", "c", "unknown_inference:none"), ("conclusion", "zz", "undeclared_conclusion")}
    v = {r.proof_id: r for r in proofs.proof_verdicts(p).collect()}
    assert {k for k, r in v.items() if r.ok} == {"good", "premise"}
    assert {k for k, r in v.items() if r.cyclic} == {"cycle", "island"}
    assert {r.claim_id for r in proofs.proof_cycles(p).collect() if r.proof_id == "cycle"} == {"c", "d"}


def test_unreached_conclusion(spark):
    spec = {"u": (["p"], [("i", "abduction_to_best_explanation", ["d"], "c"), ("k", "abduction_to_best_explanation", ["p"], "e")],
                  [("c", "i"), ("d", "i"), ("e", "k")], "c")}
    p = landed(spark, spec)
    # d is declared but put out by another step, so the only fault is its inferred_by-free origin
    v = proofs.proof_verdicts(p).first()
    assert v.error_count == 0 and v.conclusion_reached is False and not v.ok


def test_levels_and_structure(spark):
    spec = {"l": (["p", "q"], [("1", "modus_ponens", ["p", "q"], "a"), ("2", "conjunction_intro", ["a", "q"], "b"),
                               ("3", "conjunction_intro", ["p", "b", "a"], "c")],
                  [("a", "1"), ("b", "2"), ("c", "3")], "c")} | {"cycle": SPECS["cycle"]}
    p = landed(spark, spec)
    levels = {(r.proof_id, r.claim_id): r.level for r in proofs.proof_levels(p).collect()}
    assert levels == {("l", "p"): 0, ("l", "q"): 0, ("l", "a"): 1, ("l", "b"): 2, ("l", "c"): 3, ("cycle", "p"): 0}
    s = {r.proof_id: r for r in proofs.proof_structure(p).collect()}
    assert s["l"].rules_used == {"modus_ponens": 1, "conjunction_intro": 2} and s["l"].weak_rule_uses == 0
    assert (s["cycle"].premise_count, s["cycle"].inference_count, s["cycle"].weak_rule_uses) == (1, 2, 1)


def test_claims_between_cycles_are_on_none(spark):
    best = "abduction_to_best_explanation"
    steps = [("1", best, ["a"], "b"), ("2", best, ["b"], "a"), ("3", best, ["b"], "m"), ("4", best, ["m"], "c"),
             ("5", best, ["c"], "d"), ("6", best, ["d"], "c"), ("7", best, ["d"], "n"), ("8", best, ["n"], "n2"),
             ("9", best, ["s"], "s"), ("10", best, ["n2"], "s")]
    p = landed(spark, {"two": (["p"], steps, [(c, i) for i, _, _, c in steps], "d")})
    assert {r.claim_id for r in proofs.proof_cycles(p).collect()} == {"a", "b", "c", "d", "s"}


def test_level_of_a_claim_with_two_producers(spark):
    best = "abduction_to_best_explanation"
    steps = [("1", best, ["p"], "c"), ("2", best, ["c1"], "c"), ("3", best, ["p"], "c1"), ("4", best, ["c"], "d"),
             ("5", best, ["d"], "e"), ("6", "conjunction_intro", ["c", "e"], "f")]
    p = landed(spark, {"l": (["p"], steps, [("c", "1"), ("c1", "3"), ("d", "4"), ("e", "5"), ("f", "6")], "f")})
    assert {r.claim_id: r.level for r in proofs.proof_levels(p).collect()} == {"p": 0, "c1": 1, "c": 2, "d": 3, "e": 4, "f": 5}


def plain_levels(premises, steps, cyclic):
    levels = {p: 0 for p in premises}
    for _ in range(len(steps) + 2):
        for _, _, inputs, out in steps:
            if out not in cyclic and inputs and all(i in levels for i in inputs):
                levels[out] = max(levels.get(out, 0), 1 + max(levels[i] for i in inputs))
    return levels


@pytest.mark.parametrize("small", [10_000, 8])
def test_random_proofs_have_the_cycles_and_levels_of_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(proofs, "SMALL_PROOF", small)
    rnd = random.Random(11)
    specs, want, levels = {}, set(), {}
    for k in range(12):
        n = rnd.randrange(6, 14)
        names = [f"c{i:02d}" for i in range(n)]
        forward = k % 2  # half of the proofs have no cycle
        steps = []
        for j in range(rnd.randrange(2, 2 * n)):
            out = rnd.randrange(1, n)
            pool = names[:out] if forward else names
            steps.append((f"i{j}", "conjunction_intro", rnd.sample(pool, min(len(pool), rnd.choice([1, 1, 1, 2, 3]))), names[out]))
        specs[f"p{k}"] = ([names[0]], steps, [(c, "i0") for c in names[1:]], names[-1])
        ahead = {}
        for _, _, inputs, out in steps:
            for i in inputs:
                ahead.setdefault(i, set()).add(out)
        for a in names:
            seen, todo = set(), list(ahead.get(a, ()))
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += ahead.get(x, ())
            if a in seen:
                want.add((f"p{k}", a))
        cyclic = {c for p, c in want if p == f"p{k}"}
        levels |= {(f"p{k}", c): v for c, v in plain_levels([names[0]], steps, cyclic).items()}
    p = landed(spark, specs)
    got = [(r.proof_id, r.claim_id) for r in proofs.proof_cycles(p).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    made = proofs.proof_levels(p).collect()
    assert len(made) == len(levels) and {(r.proof_id, r.claim_id): r.level for r in made} == levels
