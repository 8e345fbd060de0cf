"""Ownership graph: closures, cycles, chains. Edges have columns src and dst; other columns are ignored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import Scratch


def closure(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None, backwards: bool = False) -> DataFrame:
    """src, dst, depth: all pairs along one edge or more, with the least number of edges.

    Semi-naive: a round extends only the pairs that the last one found, and an anti-join drops those known, so cycles
    end it. ``seeds`` (column id) limits where paths begin, or with ``backwards`` where they end. Rounds are written
    tables, so the lineage stays short and a lost executor costs one round.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    steps = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    if backwards:
        steps = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = scratch.table(steps, "steps")
    hop = steps.select(F.col("src").alias("mid"), F.col("dst").alias("next"))
    first = steps if seeds is None else steps.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    frontier, rounds, depth = first.withColumn("depth", F.lit(1)), [], 1
    while True:
        # Two layers a round: half as many written tables, and the second reuses the first one's shuffle.
        layers = [frontier] if not rounds else []
        for _ in range(2):
            if max_depth is not None and depth >= max_depth:
                break
            depth += 1
            known = reduce(DataFrame.unionByName, [*rounds, *layers]).select("src", "dst")
            reached = frontier.join(hop, frontier["dst"] == hop["mid"]).select("src", F.col("next").alias("dst")).distinct()
            frontier = reached.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth))
            layers.append(frontier)
        if not layers:
            break
        written = scratch.table(reduce(DataFrame.unionByName, layers), f"round-{depth}")
        rounds.append(written)
        frontier = written.filter(F.col("depth") == depth)
        if frontier.isEmpty():
            break
    found = reduce(DataFrame.unionByName, rounds)
    if backwards:
        found = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "depth")
    return found


def reflexive(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The closure with each node (column id) reaching itself at depth 0."""
    own = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("depth"))
    return own.unionByName(closed.filter("src <> dst"))


def trimmed(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The edges without those that can't lie on a cycle because an end has no edge in or none out. Two steps a round."""
    left, step = None, 0
    while True:
        for _ in range(2 if step else 0):
            entered = edges.select(F.col("dst").alias("src")).distinct()
            leaves = edges.select(F.col("src").alias("dst")).distinct()
            edges = edges.join(entered, "src", "left_semi").join(leaves, "dst", "left_semi").select("src", "dst")
        edges = scratch.table(edges, f"{name}-{step}")
        before, left, step = left, edges.count(), step + 1  # rows, from the files' footers
        if left == 0 or left == before:
            return edges


def on_cycles(edges: DataFrame) -> DataFrame:
    """id of every node that reaches itself: nodes of strongly connected components, and those with an edge to themselves.

    Each pass gives a node the least of all that reach it, its color, and goes back from the nodes that have their own
    color: what gets there within a color is a component. The next pass takes the edges between what is left. Rounds are
    written tables of one row a node, so the work grows with nodes, not with pairs.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    plain = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    rest = trimmed(plain, scratch, "rest-0")
    found = [rest.filter("src = dst").select(F.col("src").alias("id"))]
    turn = 0
    while not rest.isEmpty():
        turn += 1
        colors = _spread_least(rest, scratch, turn)
        a, b = (colors.select(F.col("id").alias(c), F.col("color").alias(f"{c}_color")) for c in ("src", "dst"))
        inner = rest.join(a, "src").join(b, "dst").filter("src_color = dst_color").select("src", "dst", F.col("src_color").alias("color"))
        members = _back_from_roots(scratch.table(inner, f"inner-{turn}"), scratch, turn)
        found.append(members)
        gone = members.unionByName(colors.filter("color = id").select("id")).distinct()
        kept = rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        rest = trimmed(kept.select("src", "dst"), scratch, f"rest-{turn}")
    return reduce(DataFrame.unionByName, found).distinct()


def _spread_least(edges: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """id, color: the least node that reaches each, itself included. Three steps a round."""
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    colors, step = nodes.select("id", F.col("id").alias("color"), F.lit(True).alias("moved")), 0
    while True:
        step += 1
        for _ in range(3):
            offered = edges.join(colors.select(F.col("id").alias("src"), "color"), "src").groupBy(F.col("dst").alias("to"))
            colors = colors.join(offered.agg(F.min("color").alias("near")), F.col("id") == F.col("to"), "left").select(
                "id", F.least("color", "near").alias("color"), F.coalesce(F.col("near") < F.col("color"), F.lit(False)).alias("moved")
            )
        colors = scratch.table(colors, f"colors-{turn}-{step}")
        if colors.filter("moved").isEmpty():
            return colors.select("id", "color")


def _back_from_roots(inner: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """id of what lies on a cycle with its color's root: roots that an edge of their color enters, and what reaches them."""
    frontier, known, step = inner.filter("dst = color").select(F.col("dst").alias("id")).distinct(), None, 0
    while True:
        step += 1
        layers = [frontier.withColumn("layer", F.lit(0))]
        for layer in (1, 2, 3):
            had = reduce(DataFrame.unionByName, layers).select("id")
            had = had if known is None else had.unionByName(known)
            back = inner.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
            frontier = back.join(had, "id", "left_anti")
            layers.append(frontier.withColumn("layer", F.lit(layer)))
        written = scratch.table(reduce(DataFrame.unionByName, layers), f"back-{turn}-{step}")
        known = written.select("id") if known is None else known.unionByName(written.select("id"))
        frontier = written.filter("layer = 3").select("id")
        if frontier.isEmpty():
            return known.distinct()


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """path (array, least node first) and length of each simple cycle, or of those up to a length.

    Paths grow only from a cycle's least node over nodes on cycles, so each cycle is found once. There can be
    exponentially many; ``max_length`` is for such graphs.
    """
    plain = edges.select("src", "dst").distinct()
    some = on_cycles(plain)
    inner = plain.join(some.withColumnRenamed("id", "src"), "src", "left_semi")
    inner = inner.join(some.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    scratch = Scratch(edges.sparkSession, "paths")
    inner = scratch.table(inner, "inner")
    hop = inner.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    paths = inner.select(F.array("src").alias("path"), F.col("dst").alias("end"))
    closed, length = [], 0
    while max_length is None or length < max_length:
        length += 1
        paths = scratch.table(paths, f"paths-{length}")
        closed.append(paths.filter(F.col("end") == F.col("path")[0]).select("path"))
        going = paths.filter((F.col("end") > F.col("path")[0]) & ~F.array_contains("path", F.col("end")))
        if going.isEmpty():
            break
        paths = going.join(hop, going["end"] == hop["at"]).select(
            F.concat("path", F.array("end")).alias("path"), F.col("next").alias("end")
        )
    found = reduce(DataFrame.unionByName, closed)
    return found.select("path", F.size("path").alias("length"))


def chains(edges: DataFrame, hops: int) -> DataFrame:
    """n0 … n<hops>: walks of that many edges."""
    plain = edges.select("src", "dst").distinct()
    walk = plain.select(F.col("src").alias("n0"), F.col("dst").alias("n1"))
    for n in range(1, hops):
        hop = plain.select(F.col("src").alias(f"n{n}"), F.col("dst").alias(f"n{n + 1}"))
        walk = walk.join(hop, f"n{n}")
    return walk.select(*[f"n{n}" for n in range(hops + 1)])
