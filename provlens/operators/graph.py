"""The provenance graph and its closures.

``nodes``: ``archive_id, kind, id``. ``edges``: ``archive_id, kind, src_kind,
src_id, dst_kind, dst_id``. An edge points from what depends to what it needs.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens.functions.ordered import sequenced
from provlens.session import landed, stable

EDGE = ["archive_id", "kind", "src_kind", "src_id", "dst_kind", "dst_id"]


def _edge(df: DataFrame, kind: str, src_kind: str, src: Column, dst_kind: str, dst: Column) -> DataFrame:
    return df.select("archive_id", F.lit(kind).alias("kind"), F.lit(src_kind).alias("src_kind"),
                     src.alias("src_id"), F.lit(dst_kind).alias("dst_kind"), dst.alias("dst_id"))


def build_graph(evidence: DataFrame, sources: DataFrame,
                assessments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and typed edges; an edge stays even when its target has no row."""
    def node(df: DataFrame, kind: str, name: str) -> DataFrame:
        return df.select("archive_id", F.lit(kind).alias("kind"), F.col(name).alias("id"))

    nodes = reduce(DataFrame.unionByName, [
        node(evidence, "evidence", "hash"), node(sources, "source", "id"),
        node(assessments, "assessment", "assessment_id")]).distinct()
    cited = assessments.select("archive_id", "assessment_id", F.explode("supporting_source_ids").alias("s"))
    edges = reduce(DataFrame.unionByName, [
        _edge(evidence, "sourced_from", "evidence", F.col("hash"), "source", F.col("source_id")),
        _edge(assessments, "assessed_from", "assessment", F.col("assessment_id"), "evidence",
              F.col("evidence_id")),
        _edge(cited, "derived_from", "assessment", F.col("assessment_id"), "source", F.col("s")),
    ]).distinct()
    return nodes, edges


def graph_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node, once per missing end."""
    def dangling(side: str) -> DataFrame:
        known = nodes.select("archive_id", F.col("kind").alias(f"{side}_kind"), F.col("id").alias(f"{side}_id"))
        return (edges.join(known, ["archive_id", f"{side}_kind", f"{side}_id"], "left_anti")
                .select(F.lit(f"dangling_{side}").alias("issue"), *EDGE))

    return dangling("src").unionByName(dangling("dst"))


def assessments_of(edges: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """``archive_id, evidence_id, assessment_id`` for all or the given evidence ids."""
    pairs = edges.filter(F.col("kind") == "assessed_from").select(
        "archive_id", F.col("dst_id").alias("evidence_id"), F.col("src_id").alias("assessment_id"))
    return pairs if evidence is None else pairs.join(evidence, ["archive_id", "evidence_id"], "left_semi")


def evidence_of(edges: DataFrame, assessments: DataFrame | None = None) -> DataFrame:
    pairs = assessments_of(edges)
    return pairs if assessments is None else pairs.join(
        assessments, ["archive_id", "assessment_id"], "left_semi")


MOST_STAGES = 8
PAIR = ["archive_id", "root", "node"]


def _name(kind: str, id: str) -> Column:
    """A node as one string, so rows are narrow to shuffle, sort and compare."""
    return F.concat_ws("\x00", kind, id)


def _kind(node: str) -> Column:
    return F.split_part(F.col(node), F.lit("\x00"), F.lit(1))


def _kind_steps(edges: DataFrame, near: str, far: str) -> dict[str, set[str]] | None:
    """Which kinds of nodes lead to which; nothing if there are too many kinds to look at."""
    found = edges.select(f"{near}_kind", f"{far}_kind").distinct().limit(1001).collect()
    if len(found) > 1000 or any(None in r for r in found):
        return None
    steps: dict[str, set[str]] = {}
    for a, b in found:
        steps.setdefault(a, set()).add(b)
    return steps


def _stages(steps: dict[str, set[str]]) -> tuple[int, bool] | None:
    """The longest way through the kinds, and whether all ways between two kinds are equally long.

    Nothing if kinds lead back to themselves.
    """
    lengths: dict[str, dict[str, set[int]]] = {}

    def of(kind: str, open_kinds: frozenset[str]) -> dict[str, set[int]] | None:
        if kind in open_kinds:
            return None
        if kind not in lengths:
            here: dict[str, set[int]] = {}
            for to in steps.get(kind, ()):
                beyond = of(to, open_kinds | {kind})
                if beyond is None:
                    return None
                here.setdefault(to, set()).add(1)
                for end, n in beyond.items():
                    here.setdefault(end, set()).update(x + 1 for x in n)
            lengths[kind] = here
        return lengths[kind]

    for kind in steps:
        if of(kind, frozenset()) is None:
            return None
    every = [n for ends in lengths.values() for n in ends.values()]
    return max((max(n) for n in every), default=0), all(len(n) == 1 for n in every)


def _staged(steps: DataFrame, frontier: DataFrame, kinds: dict[str, set[str]], stages: int, even: bool) -> DataFrame:
    """Closure of a graph whose kinds don't lead back: one join a stage in a single plan, no rounds.

    Nodes of kinds that lead nowhere are left out of the next join before they are shuffled. Where
    no node is led to by two others, a root finds none twice and nothing is sought to be dropped.
    """
    single = steps.groupBy("archive_id", "to").count().filter("count > 1").isEmpty()
    levels = []
    for distance in range(1, stages + 1):
        going = frontier.filter(_kind("node").isin(*kinds))
        frontier = going.join(steps, ["archive_id", "node"]).select("archive_id", "root", F.col("to").alias("node"))
        frontier = frontier if single else frontier.distinct()
        levels.append(frontier.withColumn("distance", F.lit(distance)))
    if not levels:
        return frontier.withColumn("distance", F.lit(0)).limit(0)
    every = reduce(DataFrame.unionByName, levels)
    return every if even else every.groupBy(*PAIR).agg(F.min("distance").alias("distance"))


def _bit_parallel(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """Breadth-first levels of 64 roots at a time: a node holds a bit for each root that has reached it.

    What was reached lies in a table bucketed by node, so a round shuffles only what it has found
    anew; cycles end when no bit is new. A level's new bits are written as they are found.
    """
    spark = steps.sparkSession
    key = ["archive_id", "block", "node"]
    numbered = stable(sequenced(roots, ["archive_id"], ["root"]).select(
        "archive_id", "root", F.floor(F.col("position") / 64).cast("long").alias("block"), (F.col("position") % 64).cast("int").alias("bit")))
    bit = F.expr("shiftleft(1L, bit)")
    frontier = numbered.select("archive_id", "block", F.col("root").alias("node"), bit.alias("new"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"closure_{uuid.uuid4().hex}"
    levels: list[DataFrame] = []
    held: str | None = None
    while True:
        found = (frontier.join(steps, ["archive_id", "node"]).groupBy("archive_id", "block", F.col("to").alias("node"))
                 .agg(F.bit_or("new").alias("found")))
        if held is None:
            # A root is reached from the start, at no distance.
            before = numbered.select("archive_id", "block", F.col("root").alias("node"), bit.alias("seen"))
        else:
            before = spark.table(held).select(*key, "seen")
        seen, now = F.coalesce("seen", F.lit(0)), F.coalesce("found", F.lit(0))
        merged = before.join(found, key, "full").select(
            *key, seen.bitwiseOR(now).alias("seen"), now.bitwiseAND(F.bitwise_not(seen)).alias("new"))
        table = f"{name}_{len(levels)}"
        merged.write.bucketBy(buckets, *key).format("parquet").saveAsTable(table)
        if held is not None:
            spark.sql(f"DROP TABLE {held}")
        held = table
        fresh = spark.table(held).filter("new <> 0").select(*key, "new")
        if fresh.isEmpty():
            spark.sql(f"DROP TABLE {held}")
            break
        frontier = landed(fresh)
        levels.append(frontier.withColumn("distance", F.lit(len(levels) + 1)))
    if not levels:
        return steps.sparkSession.createDataFrame([], "archive_id string, root string, node string, distance int")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("new", i) == 1)
    pairs = reduce(DataFrame.unionByName, levels).select(*key, "distance", F.explode(bits).alias("bit"))
    return pairs.join(numbered, ["archive_id", "block", "bit"]).select(*PAIR, "distance")


def _reach(edges: DataFrame, roots: DataFrame, incoming: bool) -> DataFrame:
    """All that roots reach, with least distance, the root itself left out.

    Where kinds of nodes don't lead back to themselves, as in an archive's own graph, the closure
    is a few joins; else it goes level by level for 64 roots at once.
    """
    near, far = ("dst", "src") if incoming else ("src", "dst")
    steps = edges.select("archive_id", _name(f"{near}_kind", f"{near}_id").alias("node"),
                         _name(f"{far}_kind", f"{far}_id").alias("to")).distinct()
    starts = roots.select("archive_id", _name("kind", "id").alias("root")).distinct()
    kinds = _kind_steps(edges, near, far)
    stages = _stages(kinds) if kinds is not None else None
    if stages is not None and stages[0] <= MOST_STAGES:
        found = _staged(steps, starts.withColumn("node", F.col("root")), kinds, *stages)
    else:
        found = _bit_parallel(stable(steps), starts)

    def part(column: str, i: int) -> Column:
        return F.split_part(F.col(column), F.lit("\x00"), F.lit(i))

    return found.select(
        "archive_id", part("root", 1).alias("root_kind"), part("root", 2).alias("root_id"),
        part("node", 1).alias("node_kind"), part("node", 2).alias("node_id"), "distance")


def dependency_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All that each root needs, the root left out; with distances."""
    return _reach(edges, roots, incoming=False)


def dependents_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All that needs each root, the root left out; with distances."""
    return _reach(edges, roots, incoming=True)


def impact(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Dependents with least distance, for roots that are nodes of the graph."""
    return dependents_closure(edges, roots.join(nodes, ["archive_id", "kind", "id"], "left_semi"))


def known_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Which roots exist; the impact of an unknown root is an error, not zero."""
    return (roots.join(nodes.select("archive_id", "kind", "id", F.lit(True).alias("exists")).distinct(),
                       ["archive_id", "kind", "id"], "left")
            .withColumn("exists", F.coalesce("exists", F.lit(False))))


def neighborhood(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Both closures with a ``direction`` of ``upstream`` or ``downstream``."""
    return (dependency_closure(edges, anchors).withColumn("direction", F.lit("upstream"))
            .unionByName(dependents_closure(edges, anchors).withColumn("direction", F.lit("downstream"))))


def explain(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Evidence or assessments of each anchor, its dependencies and its dependents."""
    pairs = assessments_of(edges)
    of_assessment = anchors.filter(F.col("kind") == "assessment").join(
        pairs, (pairs["archive_id"] == anchors["archive_id"]) & (pairs["assessment_id"] == anchors["id"])
    ).select(anchors["archive_id"], "kind", "id", F.lit("evidence").alias("relation"),
             F.lit("evidence").alias("node_kind"), F.col("evidence_id").alias("node_id"),
             F.lit(1).alias("distance"))
    of_evidence = anchors.filter(F.col("kind") == "evidence").join(
        pairs, (pairs["archive_id"] == anchors["archive_id"]) & (pairs["evidence_id"] == anchors["id"])
    ).select(anchors["archive_id"], "kind", "id", F.lit("assessment").alias("relation"),
             F.lit("assessment").alias("node_kind"), F.col("assessment_id").alias("node_id"),
             F.lit(1).alias("distance"))
    around = neighborhood(edges, anchors).select(
        "archive_id", F.col("root_kind").alias("kind"), F.col("root_id").alias("id"),
        F.when(F.col("direction") == "upstream", F.lit("dependency"))
        .otherwise(F.lit("dependent")).alias("relation"), "node_kind", "node_id", "distance")
    return of_assessment.unionByName(of_evidence).unionByName(around)
