"""Connected components by contraction (inventory F2, undirected).

Nodes are numbered once, so that all later work is on longs, and in each turn every node takes the largest number around
it, and its edges go over to that one; edges inside of a group are dropped. Numbers of the first turn grow with a node's
edges, so ends of a tree go over to their hubs at once; later ones are scrambled anew each turn, and nodes look two edges
far, so that the nodes left fall by a part in each turn whatever the graph, and the turns grow with the logarithm of a
component's size. A turn reads only the edges that the last one left, not all of them. No node's neighbours are collected:
their maximum is combined before the shuffle and joined back by a join that the adaptive plan splits at a hub. Each turn
is written to the shared folder, so lineage is one turn long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkmoot._store import kept, workspace


def _both(e: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))
    return e.select(F.explode(ends).alias("x")).select("x.u", "x.v")


def _numbered(ends: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(node, number) of all nodes, a node with twice the edges above all others, and the edges between numbers."""
    counted = _both(ends).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    number = F.shiftleft(F.floor(F.log2("n")).cast("long"), 57) + F.monotonically_increasing_id()
    nodes = kept(counted.select("node", number.alias("number")), "nodes", folder)
    named = ends.filter("hi <> lo").join(nodes.withColumnsRenamed({"node": "hi", "number": "a"}), "hi").join(nodes.withColumnsRenamed({"node": "lo", "number": "b"}), "lo")
    return nodes, kept(named.select(F.col("a").alias("hi"), F.col("b").alias("lo")), "numbered", folder)


def _scrambled(number: Column, turns: int = 1) -> Column:
    """Another long for each long, one to one: of a single long, each step of xxhash64 can be undone."""
    return reduce(lambda c, _: F.xxhash64(c), range(turns), number)


def _labels(e: DataFrame, far: bool, folder: str) -> DataFrame:
    """(u, label): the largest number among a node and its neighbours, ``far``: and those of its neighbours, scrambled."""
    both = _both(e)
    label = both.groupBy("u").agg(F.max("v").alias("m")).select("u", F.greatest("u", "m").alias("label"))
    if far:
        near = kept(label, "near", folder)
        around = both.join(near.select(F.col("u").alias("v"), "label"), "v").select("u", "label")
        label = around.unionByName(near).groupBy("u").agg(F.max("label").alias("label"))
    return kept(label.select("u", _scrambled(F.col("label")).alias("label")), "labels", folder)


def _contracted(e: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    moved = e.join(labels.withColumnsRenamed({"u": "hi", "label": "a"}), "hi").join(labels.withColumnsRenamed({"u": "lo", "label": "b"}), "lo").filter("a <> b")
    return kept(moved.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges", folder)


def _state(e: DataFrame) -> bool:
    """Whether a turn has edges left to contract."""
    return not e.isEmpty()


def components(edges: DataFrame, source: str = "source_id", target: str = "target_id", max_turns: int = 100, named: bool = True) -> DataFrame:
    """(node, component) of every node of the edges, whichever way they point; a component is named by its smallest node, or
    by a number that holds for this result alone.

    Loops make their node known, repeated edges count once, edges without one of their ends are left out. Nodes may be of
    any type that has an order. No edges give no rows.
    """
    with workspace(edges.sparkSession, "components") as folder:
        ends = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a is not null and b is not null")
        ends = kept(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "ends", folder)
        nodes, left = _numbered(ends, folder)
        turns: list[DataFrame] = []
        while _state(left):
            if len(turns) == max_turns:
                raise RuntimeError("max_turns reached")
            turns.append(_labels(left, bool(turns), folder))
            left = _contracted(left, turns[-1], folder)
        below = None  # the component of each node of a turn, from the last turn to the first
        for turn in range(len(turns) - 1, -1, -1):
            done = _scrambled(F.col("label"), len(turns) - 1 - turn)
            found = turns[turn].select("u", done.alias("component")) if below is None else turns[turn].join(below.withColumnRenamed("u", "label"), "label", "left").select("u", F.coalesce("component", done).alias("component"))
            below = kept(found, "found", folder) if turn else found
        alone = _scrambled(F.col("number"), len(turns))
        if below is None:
            rooted = nodes.select("node", alone.alias("component"))
        else:
            rooted = nodes.join(below.withColumnRenamed("u", "number"), "number", "left").select("node", F.coalesce("component", alone).alias("component"))
        if not named:
            return kept(rooted, "components")
        rooted = kept(rooted, "rooted", folder)
        names = rooted.groupBy("component").agg(F.min("node").alias("name"))
        return kept(rooted.join(names, "component").select("node", F.col("name").alias("component")), "components")
