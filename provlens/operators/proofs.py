"""Structure of inference proofs: rules, references, cycles, reach and levels.

Landed proofs are exploded into claims and steps first, so a very large proof is
spread by claim id like everything else.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens.session import stable

# Rule, least inputs, most inputs (None: no limit), classification.
RULES = [
    ("modus_ponens", 2, 2, "deductive"),
    ("conjunction_intro", 2, None, "deductive"),
    ("inference_to_specific_instance", 2, 2, "deductive"),
    ("elimination_by_contradiction", 2, 2, "deductive"),
    ("abduction_to_best_explanation", 1, None, "weak"),
]
PROOF_TYPE = "^[A-Za-z][A-Za-z0-9]*\\.justification\\.inference-proof\\.v1$"
KEY = ["archive_id", "proof_id"]


def _pick(rule: Column, values: dict[str, object]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), rule)


def is_weak(rule: Column) -> Column:
    return rule.isin([r[0] for r in RULES if r[3] == "weak"])


def rule_known(rule: Column) -> Column:
    return rule.isin([r[0] for r in RULES])


def arity_error(rule: Column, count: Column) -> Column:
    """What is wrong with the number of inputs of a known rule, else null."""
    least = _pick(rule, {r[0]: r[1] for r in RULES})
    most = _pick(rule, {r[0]: r[2] for r in RULES if r[2] is not None})
    return (F.when(~rule_known(rule), F.lit("unknown_rule"))
            .when(count < least, F.lit("too_few_inputs"))
            .when(count > most, F.lit("too_many_inputs")))


def rule_arity_ok(rule: Column, count: Column) -> Column:
    return arity_error(rule, count).isNull()


class Proofs(NamedTuple):
    """Proofs in long form, every frame keyed by ``archive_id, proof_id``.

    ``heads``: proof_type, proof_hash, target_justification_id,
    target_justification_hash, conclusion_claim_id. ``premises``: position,
    claim_id. ``references``: position, claim_id, evidence_hash. ``steps``:
    inference_id, rule, output_id. ``inputs``: inference_id, claim_id.
    ``claims``: claim_id, inferred_by.
    """

    heads: DataFrame
    premises: DataFrame
    references: DataFrame
    steps: DataFrame
    inputs: DataFrame
    claims: DataFrame


def explode_proofs(landed: DataFrame) -> Proofs:
    """Long form of landed proofs."""
    premises = landed.select(*KEY, F.posexplode("premises").alias("position", "p"))
    steps = landed.select(*KEY, F.explode("inferences").alias("i"))
    return Proofs(
        landed.select(*KEY, "proof_type", "proof_hash", "target_justification_id",
                      "target_justification_hash", "conclusion_claim_id"),
        premises.select(*KEY, "position", F.col("p.id").alias("claim_id")),
        premises.select(*KEY, "position", F.col("p.id").alias("claim_id"),
                        F.explode("p.evidence_refs").alias("evidence_hash")),
        steps.select(*KEY, F.col("i.id").alias("inference_id"), "i.rule",
                     F.col("i.output_claim_id").alias("output_id")),
        steps.select(*KEY, F.col("i.id").alias("inference_id"),
                     F.explode("i.input_claim_ids").alias("claim_id")),
        landed.select(*KEY, F.explode("derived_claims").alias("c")).select(
            *KEY, F.col("c.id").alias("claim_id"), "c.inferred_by"))


def proof_references(proofs: Proofs) -> DataFrame:
    """One row per proof and cited hash, with the first premise that cites it."""
    cited = proofs.references.groupBy(*KEY, F.col("evidence_hash").alias("hash")).agg(
        F.min_by("claim_id", "position").alias("matched_premise_id"))
    sizes = proofs.steps.groupBy(*KEY).agg(
        F.count("*").alias("inference_count"),
        F.count_if(is_weak(F.col("rule"))).alias("weak_inference_count"))
    return (cited.join(proofs.heads.drop("proof_type"), KEY).join(sizes, KEY, "left")
            .fillna(0, ["inference_count", "weak_inference_count"]))


def proofs_citing(evidence: DataFrame, proofs: Proofs) -> DataFrame:
    return (evidence.select("archive_id", "hash")
            .join(proof_references(proofs), ["archive_id", "hash"]))


def proof_structure(proofs: Proofs) -> DataFrame:
    """Element counts, rule histogram and weak uses; only known rules are counted."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*KEY).agg(F.count("*").alias(name))

    known = proofs.steps.filter(rule_known(F.col("rule"))).groupBy(*KEY, "rule").agg(F.count("*").alias("n"))
    rules = known.groupBy(*KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("rules_used"),
        F.sum(F.when(is_weak(F.col("rule")), F.col("n")).otherwise(0)).alias("weak_rule_uses"))
    names = ["premise_count", "inference_count", "derived_claim_count"]
    frames = [count(proofs.premises, names[0]), count(proofs.steps, names[1]),
              count(proofs.claims, names[2]), rules]
    return reduce(lambda a, b: a.join(b, KEY, "left"), frames, proofs.heads.select(*KEY)).fillna(
        0, [*names, "weak_rule_uses"])


def claim_edges(proofs: Proofs) -> DataFrame:
    """``source`` claim feeds a step that puts out ``target``."""
    return (proofs.inputs.withColumnRenamed("claim_id", "source")
            .join(proofs.steps.select(*KEY, "inference_id", F.col("output_id").alias("target")),
                  [*KEY, "inference_id"])
            .select(*KEY, "source", "target").distinct())


def proof_errors(proofs: Proofs) -> DataFrame:
    """``archive_id, proof_id, subject, error`` for every structural fault but cycles."""
    steps, derived = proofs.steps, proofs.claims
    known = steps.filter(rule_known(F.col("rule")))
    claims = proofs.premises.select(*KEY, "claim_id").unionByName(derived.select(*KEY, "claim_id")).distinct()
    counts = proofs.inputs.groupBy(*KEY, "inference_id").agg(F.count("*").alias("n"))

    def errors(df: DataFrame, subject: str, error: Column) -> DataFrame:
        return (df.select(*KEY, F.col(subject).alias("subject"), error.alias("error"))
                .filter("error IS NOT NULL"))

    vocabulary = errors(steps, "inference_id", F.when(~rule_known(F.col("rule")), F.lit("unknown_rule")))
    arity = errors(known.join(counts, [*KEY, "inference_id"], "left"), "inference_id",
                   arity_error(F.col("rule"), F.coalesce("n", F.lit(0))))
    inputs = proofs.inputs.join(known.select(*KEY, "inference_id"), [*KEY, "inference_id"], "left_semi")
    unknown_inputs = errors(inputs.join(claims, [*KEY, "claim_id"], "left_anti"), "inference_id",
                            F.concat(F.lit("unknown_input:"), F.col("claim_id")))
    outputs = known.select(*KEY, "inference_id", F.col("output_id").alias("claim_id")).join(
        derived, [*KEY, "claim_id"], "left")
    output_errors = errors(outputs, "inference_id", F.when(
        F.col("inferred_by").isNull(), F.concat(F.lit("undeclared_output:"), F.col("claim_id")))
        .when(F.col("inferred_by") != F.col("inference_id"),
              F.concat(F.lit("inferred_by_disagrees:"), F.col("inferred_by"))))
    orphans = errors(
        derived.join(steps.select(*KEY, F.col("inference_id").alias("inferred_by")).distinct(),
                     [*KEY, "inferred_by"], "left_anti"),
        "claim_id", F.concat(F.lit("unknown_inference:"), F.col("inferred_by")))
    conclusions = errors(
        proofs.heads.select(*KEY, F.col("conclusion_claim_id").alias("claim_id"))
        .join(claims, [*KEY, "claim_id"], "left_anti"), "claim_id", F.lit("undeclared_conclusion"))
    types = errors(proofs.heads, "proof_id", F.when(
        ~F.coalesce(F.col("proof_type").rlike(PROOF_TYPE), F.lit(False)), F.lit("unexpected_proof_type")))
    return reduce(DataFrame.unionByName, [vocabulary, arity, unknown_inputs, output_errors, orphans,
                                          conclusions, types])


SMALL_PROOF = 10_000  # inputs of a proof that one task looks at as a whole


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of proofs that are small, and of those that are not; nothing for the latter if there are none."""
    sizes = stable(rows.groupBy(*KEY).agg(F.count("*").alias("_size")))
    if sizes.filter(F.col("_size") > SMALL_PROOF).isEmpty():
        return rows, None
    sized = rows.join(sizes, KEY)
    return sized.filter(F.col("_size") <= SMALL_PROOF).drop("_size"), sized.filter(F.col("_size") > SMALL_PROOF).drop("_size")


def strong_components(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Groups of claims that reach each other, what comes later in a proof first (Tarjan's algorithm, without recursion)."""
    ahead: dict[str, list[str]] = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    waiting: set[str] = set()
    out: list[list[str]] = []
    for start in ahead:
        if start in number:
            continue
        path = [(start, iter(ahead[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        waiting.add(start)
        while path:
            claim, following = path[-1]
            for b in following:
                if b not in number:
                    number[b] = low[b] = len(number)
                    stack.append(b)
                    waiting.add(b)
                    path.append((b, iter(ahead[b])))
                    break
                if b in waiting:
                    low[claim] = min(low[claim], number[b])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[claim])
                if low[claim] == number[claim]:
                    at = stack.index(claim) if len(stack) < 64 else len(stack) - 1 - stack[::-1].index(claim)
                    out.append(stack[at:])
                    waiting.difference_update(stack[at:])
                    del stack[at:]
    return out


def cycle_claims(edges: list[tuple[str, str]]) -> set[str]:
    own = {a for a, b in edges if a == b}
    return {c for part in strong_components(edges) for c in part if len(part) > 1 or c in own}


def claim_levels(premises: set[str], inputs: list[tuple[str, str, str]]) -> dict[str, int]:
    """Levels of one proof's claims; ``inputs`` are (step, claim it gives, claim it takes)."""
    edges = [(c, t) for _, t, c in inputs]
    cyclic = cycle_claims(edges)
    steps: dict[str, dict[str, list[str]]] = {}
    for i, t, c in inputs:
        if t not in cyclic:
            steps.setdefault(t, {}).setdefault(i, []).append(c)
    levels = dict.fromkeys(premises, 0)
    for part in reversed(strong_components(edges)):
        for claim in part:
            for taken in steps.get(claim, {}).values():
                if all(c in levels for c in taken):
                    levels[claim] = max(levels.get(claim, 0), 1 + max(levels[c] for c in taken))
    return levels


def _small_cycles(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, p, c) for a, p, e in zip(*(x.to_pylist() for x in batch.columns))
                    for c in sorted(cycle_claims([(x["source"], x["target"]) for x in e]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], [*KEY, "claim_id"])

    return edges.groupBy(*KEY).agg(F.collect_list(F.struct("source", "target"))).mapInArrow(
        run, "archive_id string, proof_id string, claim_id string")


def _small_levels(inputs: DataFrame, premises: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, p, c, n) for a, p, i, given in zip(*(x.to_pylist() for x in batch.columns))
                    for c, n in claim_levels(set(given or ()), [(x["inference_id"], x["target"], x["claim_id"]) for x in i]).items()]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[i] for r in rows], pa.string()) for i in range(3)], pa.array([r[3] for r in rows], pa.int32())],
                [*KEY, "claim_id", "level"])

    listed = inputs.groupBy(*KEY).agg(F.collect_list(F.struct("inference_id", "target", "claim_id")).alias("i"))
    given = premises.groupBy(*KEY).agg(F.collect_set("claim_id").alias("given"))
    return listed.join(given, KEY, "left").mapInArrow(run, "archive_id string, proof_id string, claim_id string, level int")


def _trimmed(live: DataFrame) -> DataFrame:
    """Edges left after claims that feed nothing or are fed by nothing lose theirs, once."""
    fed = live.select(*KEY, F.col("target").alias("source")).distinct()
    feeds = live.select(*KEY, F.col("source").alias("target")).distinct()
    return stable(live.join(fed, [*KEY, "source"], "left_semi")
                  .join(feeds, [*KEY, "target"], "left_semi").select(*KEY, "source", "target"))


def _jumped(pointers: DataFrame) -> DataFrame:
    """Follow pointers to where they end: ``KEY, claim_id, end, steps``; those on a ring have a null ``end``.

    ``least`` is the least claim on the way, so all claims of a ring have the same.

    ``pointers`` has ``KEY, claim_id, next``, at most one row a claim; a claim without a row is
    an end. Every round doubles how far a pointer reaches, so a line or ring of n claims takes
    about log2(n) rounds.
    """
    open_ones = stable(pointers.select(*KEY, "claim_id", F.col("next").alias("end"), F.lit(1).cast("long").alias("steps"),
                                        F.col("claim_id").alias("least")))
    # No line or ring is longer than the most pointers of a proof.
    total = open_ones.groupBy(*KEY).count().agg(F.max("count")).first()[0] or 0
    left, reach, done = total, 1, []
    while left and reach <= total:
        ahead = [d.withColumn("_ended", F.lit(True)) for d in done] + [open_ones.withColumn("_ended", F.lit(False))]
        ahead = reduce(DataFrame.unionByName, ahead).select(
            *KEY, F.col("claim_id").alias("end"), F.col("end").alias("_end"), F.col("steps").alias("_steps"), F.col("least").alias("_least"), "_ended")
        joined = stable(open_ones.join(ahead, [*KEY, "end"], "left").select(
            *KEY, "claim_id", F.coalesce("_end", "end").alias("end"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.least("least", "_least").alias("least"), F.coalesce("_ended", F.lit(True)).alias("_ended")))
        done.append(joined.filter("_ended").drop("_ended"))
        open_ones = joined.filter("NOT _ended").drop("_ended")
        left, reach = open_ones.count(), reach * 2
    rings = open_ones.withColumn("end", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, done, rings)


def _contracted(live: DataFrame, stay: DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Edges with every line of claims that have one edge in and one out as a single edge.

    Also the claims taken out: ``KEY, claim_id, first, last, least`` with the claims at both ends
    of their line, null for claims of a ring of such claims alone, which share their ``least``. Claims of ``stay`` are kept.
    Nothing if there are none to take out.
    """
    degrees = (live.select(*KEY, F.col("source").alias("claim_id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
               .unionByName(live.select(*KEY, F.col("target").alias("claim_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
               .groupBy(*KEY, "claim_id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).filter("o = 1 AND i = 1"))
    # A claim that feeds itself alone is a ring of one.
    if stay is not None:
        degrees = degrees.join(stay, [*KEY, "claim_id"], "left_anti")
    links = stable(degrees.select(*KEY, "claim_id"))
    if links.isEmpty():
        return None
    ahead = live.join(links.withColumnRenamed("claim_id", "source"), [*KEY, "source"], "left_semi")
    behind = live.join(links.withColumnRenamed("claim_id", "target"), [*KEY, "target"], "left_semi")
    last = _jumped(ahead.select(*KEY, F.col("source").alias("claim_id"), F.col("target").alias("next")))
    first = _jumped(behind.select(*KEY, F.col("target").alias("claim_id"), F.col("source").alias("next")))
    out = stable(last.select(*KEY, "claim_id", F.col("end").alias("last"), "least").join(
        first.select(*KEY, "claim_id", F.col("end").alias("first")), [*KEY, "claim_id"]))
    gone = links.select(*KEY, F.col("claim_id").alias("source"))
    direct = live.join(gone, [*KEY, "source"], "left_anti").join(gone.withColumnRenamed("source", "target"), [*KEY, "target"], "left_anti")
    lines = out.filter("first IS NOT NULL").select(*KEY, F.col("first").alias("source"), F.col("last").alias("target"))
    return stable(direct.select(*KEY, "source", "target").unionByName(lines).distinct()), out


def _peeled(live: DataFrame, rounds: int | None = None) -> DataFrame:
    """Trimmed as long as that changes anything, or for some rounds."""
    left = live.count()
    while left and rounds != 0:
        live = _trimmed(live)
        now = live.count()
        if now == left:
            break
        left, rounds = now, None if rounds is None else rounds - 1
    return live


SHORT_ROUNDS = 4


def _reduced(live: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What trimming and contracting leave, and the lines that were taken out each time.

    Most proofs are a few steps deep and are gone after some rounds of trimming.
    """
    taken: list[DataFrame] = []
    live = _peeled(live, SHORT_ROUNDS)
    left = live.count()
    while left:
        smaller = _contracted(live)
        if smaller is not None:
            live = smaller[0]
            taken.append(smaller[1])
        live = _trimmed(live)
        now = live.count()
        if now == left and smaller is None:
            break
        left = now
    return live, taken


def _strong_parts(live: DataFrame) -> DataFrame:
    """``KEY, claim_id, root`` for the claims that both reach and are reached by their root.

    A root is a claim that no larger one reaches; every round moves only what changed.
    """
    nodes = live.select(*KEY, F.col("source").alias("claim_id")).unionByName(
        live.select(*KEY, F.col("target").alias("claim_id"))).distinct()
    colours = stable(nodes.withColumn("root", F.col("claim_id")))
    changed = colours
    while True:
        offered = (live.join(changed.withColumnRenamed("claim_id", "source"), [*KEY, "source"])
                   .groupBy(*KEY, F.col("target").alias("claim_id")).agg(F.max("root").alias("offer")))
        changed = stable(colours.join(offered, [*KEY, "claim_id"]).filter("offer > root")
                         .select(*KEY, "claim_id", F.col("offer").alias("root")))
        if changed.isEmpty():
            break
        colours = stable(colours.unionByName(changed).groupBy(*KEY, "claim_id").agg(F.max("root").alias("root")))
    inner = stable(live.join(colours.select(*KEY, F.col("claim_id").alias("source"), "root"), [*KEY, "source"])
                   .join(colours.select(*KEY, F.col("claim_id").alias("target"), "root"), [*KEY, "target", "root"]))
    found = frontier = stable(colours.filter("claim_id = root"))
    while True:
        frontier = stable(inner.join(frontier.select(*KEY, "root", F.col("claim_id").alias("target")), [*KEY, "root", "target"])
                          .select(*KEY, F.col("source").alias("claim_id"), "root").distinct()
                          .join(found, [*KEY, "claim_id"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = stable(found.unionByName(frontier))


def proof_cycles(proofs: Proofs) -> DataFrame:
    """Claims that lie on a cycle. Small proofs are looked at as a whole, large ones in rounds over all of them."""
    small, large = _parted(claim_edges(proofs))
    found = _small_cycles(small)
    return found if large is None else found.unionByName(_large_cycles(large))


def _large_cycles(edges: DataFrame) -> DataFrame:
    """Claims on cycles of proofs of any size.

    What feeds nothing or is fed by nothing is trimmed off, and lines of claims with one edge in
    and one out become single edges, in rounds that double their reach; mostly nothing is left.
    The rest falls into parts whose claims all reach each other; a part of several claims, or of
    one that feeds itself, is a cycle. Parts are taken out until none is left. A claim of a line
    is on a cycle if both ends of the line are in one part.
    """
    live, taken = _reduced(stable(edges))
    parts: list[DataFrame] = []
    while not live.isEmpty():
        found = _strong_parts(live)
        several = found.groupBy(*KEY, "root").count().filter("count > 1").select(*KEY, "root")
        own = live.filter("source = target").select(*KEY, F.col("source").alias("root"))
        parts.append(found.join(several.unionByName(own).distinct(), [*KEY, "root"], "left_semi").select(*KEY, "claim_id", "root"))
        gone = found.select(*KEY, "claim_id")
        live = _peeled(stable(live.join(gone.withColumnRenamed("claim_id", "source"), [*KEY, "source"], "left_anti")
                              .join(gone.withColumnRenamed("claim_id", "target"), [*KEY, "target"], "left_anti")
                              .select(*KEY, "source", "target")))
    if not parts and not taken:
        return live.select(*KEY, F.col("source").alias("claim_id"))
    none = live.select(*KEY, F.col("source").alias("claim_id"), F.col("source").alias("root")).limit(0)
    cyclic = stable(reduce(DataFrame.unionByName, parts, none)) if parts else none
    for lines in reversed(taken):
        rings = lines.filter("first IS NULL").select(*KEY, "claim_id", F.col("least").alias("root"))
        at = lambda end: cyclic.select(*KEY, F.col("claim_id").alias(end), F.col("root").alias(f"{end}_root"))
        inside = (lines.join(at("first"), [*KEY, "first"]).join(at("last"), [*KEY, "last"])
                  .filter("first_root = last_root").select(*KEY, "claim_id", F.col("first_root").alias("root")))
        cyclic = stable(cyclic.unionByName(rings).unionByName(inside))
    return cyclic.select(*KEY, "claim_id")


def reached_claims(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Claims that can be reached from the ``starts`` of the same proof, those included.

    Lines of claims are walked in rounds that double their reach; what is left goes level by level.
    """
    edges = stable(edges)
    begin = stable(starts.select(*KEY, "claim_id").distinct())
    smaller = _contracted(edges, begin)
    walked, lines = smaller if smaller is not None else (edges, None)
    frontier, levels = begin, [begin]
    while True:
        seen = reduce(DataFrame.unionByName, levels)
        frontier = stable(frontier.join(walked.withColumnRenamed("source", "claim_id"), [*KEY, "claim_id"])
                          .select(*KEY, F.col("target").alias("claim_id")).distinct()
                          .join(seen, [*KEY, "claim_id"], "left_anti"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    reached = reduce(DataFrame.unionByName, levels)
    if lines is None:
        return reached
    return reached.unionByName(lines.join(reached.withColumnRenamed("claim_id", "first"), [*KEY, "first"], "left_semi")
                               .select(*KEY, "claim_id"))


def proof_verdicts(proofs: Proofs) -> DataFrame:
    """Per proof: errors, cyclic or not, and whether the conclusion is reached.

    Reach is only asked of proofs without any other fault. Where each derived claim is put out by
    a step, it is sure: steps have inputs, so the way back from the conclusion ends at a premise.
    Only proofs with a claim that no step puts out are walked.
    """
    faults = proof_errors(proofs).groupBy(*KEY).agg(F.count("*").alias("error_count"))
    cyclic = proof_cycles(proofs).select(*KEY).distinct().withColumn("cyclic", F.lit(True))
    made = proofs.steps.select(*KEY, F.col("output_id").alias("claim_id")).distinct()
    given = made.unionByName(proofs.premises.select(*KEY, "claim_id"))
    loose = (proofs.claims.select(*KEY, "claim_id").join(given, [*KEY, "claim_id"], "left_anti")
             .select(*KEY).distinct().withColumn("loose", F.lit(True)))
    heads = stable(proofs.heads.select(*KEY, "conclusion_claim_id")
                   .join(faults, KEY, "left").join(cyclic, KEY, "left").join(loose, KEY, "left")
                   .withColumn("error_count", F.coalesce("error_count", F.lit(0)))
                   .withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
                   .withColumn("loose", F.coalesce("loose", F.lit(False))))
    checked = (F.col("error_count") == 0) & ~F.col("cyclic")
    walked = stable(heads.filter(checked & F.col("loose")).select(*KEY))
    if walked.isEmpty():
        joined = heads.withColumn("reached", F.lit(None).cast("boolean"))
    else:
        reached = reached_claims(claim_edges(proofs).join(walked, KEY, "left_semi"), proofs.premises.join(walked, KEY, "left_semi"))
        joined = heads.join(reached.select(*KEY, F.col("claim_id").alias("conclusion_claim_id"), F.lit(True).alias("reached")),
                            [*KEY, "conclusion_claim_id"], "left")
    reach = F.when(F.col("loose"), F.coalesce("reached", F.lit(False))).otherwise(F.lit(True))
    return (joined.withColumn("conclusion_reached", F.when(checked, reach))
            .withColumn("ok", checked & reach)
            .select(*KEY, "error_count", "cyclic", "conclusion_reached", "ok"))


def proof_levels(proofs: Proofs) -> DataFrame:
    """Level of each claim: premises 0, else one above the highest input of any step that gives it.

    A step counts once all its inputs have a level, and again when one rises; claims on cycles
    never get one. Small proofs are looked at as a whole, large ones in rounds over all of them.
    """
    given = proofs.inputs.distinct().join(
        proofs.steps.select(*KEY, "inference_id", F.col("output_id").alias("target")).distinct(), [*KEY, "inference_id"])
    small, large = _parted(given)
    premises = proofs.premises.select(*KEY, "claim_id").distinct()
    made = _small_levels(small, premises)
    if large is not None:
        large = stable(large)
        of_large = large.select(*KEY).distinct()
        made = made.unionByName(_large_levels(large, premises.join(of_large, KEY, "left_semi")))
    # Proofs without steps have their premises only.
    return made.unionByName(premises.join(given.select(*KEY).distinct(), KEY, "left_anti").withColumn("level", F.lit(0)))


def _large_levels(given: DataFrame, premises: DataFrame) -> DataFrame:
    """Levels of proofs of any size.

    Premises that no step gives stay at 0 and so never decide beside another input. A claim that
    one step gives from one deciding input lies on a line; lines are ranked by pointers that
    double, and only the other claims go round by round. A step counts down the inputs that it
    waits for, so no round counts inputs again.
    """
    step = [*KEY, "inference_id", "target"]
    edges = given.select(*KEY, F.col("claim_id").alias("source"), "target").distinct()
    inputs = stable(given.join(_large_cycles(edges).withColumnRenamed("claim_id", "target"), [*KEY, "target"], "left_anti"))
    fixed = premises.join(inputs.select(*KEY, F.col("target").alias("claim_id")).distinct(), [*KEY, "claim_id"], "left_anti")
    marked = inputs.join(fixed.withColumn("fixed", F.lit(True)), [*KEY, "claim_id"], "left")
    # A step of fixed inputs alone keeps one of them.
    chosen = F.max(F.struct(F.col("fixed").isNull().alias("free"), "claim_id"))
    per_step = stable(marked.groupBy(*step).agg(
        F.count_if(F.col("fixed").isNull()).alias("free"), chosen["claim_id"].alias("one")))
    decided = stable(marked.join(per_step.select(*step, "free", "one"), step).filter(
        F.col("fixed").isNull() | ((F.col("free") == 0) & (F.col("claim_id") == F.col("one")))).select(*step, "claim_id"))
    line = (per_step.groupBy(*KEY, F.col("target").alias("claim_id")).agg(
        F.count("*").alias("makers"), F.max("free").alias("free"), F.max("one").alias("next"))
        .filter("makers = 1 AND free <= 1").join(premises, [*KEY, "claim_id"], "left_anti"))
    ranked = stable(_jumped(line.select(*KEY, "claim_id", "next")).filter("end IS NOT NULL"))

    # Steps that give other claims, with their inputs as places on lines.
    place = ranked.select(*KEY, "claim_id", F.col("end").alias("root"), "steps")
    waits = stable(decided.join(ranked.select(*KEY, F.col("claim_id").alias("target")), [*KEY, "target"], "left_anti")
                   .join(place, [*KEY, "claim_id"], "left")
                   .select(*step, "claim_id", F.coalesce("root", "claim_id").alias("root"), F.coalesce("steps", F.lit(0)).alias("offset")))
    state = stable(waits.groupBy(*step).agg(F.count("*").alias("open"), F.lit(-1).cast("long").alias("top")))
    levels = changed = stable(premises.select(*KEY, "claim_id", F.lit(0).cast("long").alias("level"), F.lit(True).alias("new")))
    while not changed.isEmpty():
        came = (waits.join(changed.select(*KEY, F.col("claim_id").alias("root"), "level", "new"), [*KEY, "root"])
                .groupBy(*step).agg(F.count_if("new").alias("got"), F.max(F.col("level") + F.col("offset")).alias("best")))
        state = stable(state.join(came, step, "left").select(
            *step, (F.col("open") - F.coalesce("got", F.lit(0))).alias("open"),
            F.greatest("top", F.coalesce("best", F.lit(-1))).alias("top"), F.col("best").isNotNull().alias("touched")))
        made = (state.filter("open = 0 AND touched").groupBy(*KEY, F.col("target").alias("claim_id"))
                .agg((F.max("top") + 1).alias("made")))
        changed = stable(made.join(levels.select(*KEY, "claim_id", "level"), [*KEY, "claim_id"], "left").filter("level IS NULL OR made > level")
                         .select(*KEY, "claim_id", F.col("made").alias("level"), F.col("level").isNull().alias("new")))
        levels = stable(levels.unionByName(changed).groupBy(*KEY, "claim_id").agg(F.max("level").alias("level"), F.lit(True).alias("new")))
        state = state.drop("touched")
    known = levels.select(*KEY, "claim_id", "level")
    on_lines = place.join(known.withColumnRenamed("claim_id", "root"), [*KEY, "root"]).select(
        *KEY, "claim_id", (F.col("level") + F.col("steps")).alias("level"))
    return known.unionByName(on_lines).withColumn("level", F.col("level").cast("int"))
