"""Connected components with shuffles only: alternating large and small stars.

In each round every node hands its larger neighbours (large star), then all its neighbours
(small star), to its smallest one, until the edges are stars around the smallest node of
each component. The edges are written to the shared folder after each round, so a lost
executor repeats one round at most, and nothing but three numbers comes to the driver: how many
edges there are, how many nodes are not yet in a star, and the most edges of a node. Edges that
are stars already need no round.

A minimum per node is combined before the shuffle. If a node has many edges, it goes back to the
edges of such hubs by a broadcast: a node is a hub if it has one in ``HUBS`` of all edge ends, so
there are at most ``HUBS`` of them, however large the graph. The other nodes' edges are joined
by a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.session import stage


#: So many nodes can be hubs, at the most.
HUBS = 5_000
#: A node of fewer edges is none.
HUB_EDGES = 500


def _stars(edges: DataFrame, ends: int, most: int, member: Column) -> DataFrame:
    """Every neighbour that is a ``member``, tied to the smallest of its node's closed neighbourhood.

    ``edges`` has at most ``ends`` rows, and at most ``most`` of a node.
    """
    least = edges.groupBy(F.col("u").alias("_u")).agg(
        F.least(F.min("v"), F.col("_u")).alias("m"), F.count(F.lit(1)).alias("_degree")
    )
    here = F.col("u") == F.col("_u")
    share = max(HUB_EDGES, math.ceil(ends / HUBS))
    if most < share:
        met = edges.join(least.drop("_degree").hint("merge"), here)
    else:
        hub = F.col("_degree") >= share
        hubs = F.broadcast(stage(least.filter(hub).drop("_degree"), "hubs"))
        others = least.filter(~hub).drop("_degree").hint("merge")
        met = edges.join(hubs, here).unionByName(edges.join(hubs, here, "left_anti").join(others, here))
    pair = F.array(
        F.when(member, F.struct(F.col("v").alias("u"), F.col("m").alias("v"))),
        F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
    )
    pairs = met.select(F.explode(F.array_compact(pair)).alias("e")).select("e.u", "e.v")
    return pairs.filter("u != v").distinct()


def _state(star: DataFrame) -> tuple[int, int, int]:
    """How many edges, how many nodes that are not in a star, and the most edges of a node.

    Edges go from a node to a smaller one. They are stars if no node has two smaller neighbours,
    or a smaller and a larger one.
    """
    ends = star.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        star.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    nodes = ends.groupBy("n").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    restless = F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))
    found = nodes.agg(F.sum("down"), restless, F.max(F.col("down") + F.col("up"))).first()
    return found[0] or 0, found[1], found[2] or 0


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node on an edge.

    Null ends and loops are ignored; edges may repeat; no edges give an empty table.
    """
    both = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u != v")
    star = stage(
        both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while True:
        number, restless, most = _state(star)
        if not restless:
            break
        around = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(around, 2 * number, most, F.col("v") > F.col("u"))
        # After the large star each edge points from a node to a smaller one. Each end has made
        # two rows at most, and no node has more smaller neighbours than it had neighbours.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        star = stage(_stars(stage(down, "edges"), 4 * number, most, F.lit(True)), "edges")
    # At rest every edge ties a node to the smallest of its component.
    nodes = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
