"""Connected components by alternating large-star and small-star steps on a table of edges.

Both steps replace edges by edges to smaller nodes and keep the components; rows never exceed twice
the edges. Each round is written to the shared folder, so that lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Edges of one node that go to one task.
EDGES = 500_000


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One step on edges (u, v), u > v. Minima are aggregated before the shuffle; a node's edges are never gathered.

    most: the edges that any node has. Beyond EDGES, every node's edges are dealt to as many tasks as that needs.
    """
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    least = least.select("c", F.least("c", "m").alias("m"))
    if (parts := -(-most // EDGES)) > 1:
        left = both.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))
        right = least.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
        near = left.join(right, (F.col("u") == F.col("c")) & (F.col("part") == F.col("to"))).drop("part", "to")
    else:
        near = both.join(least, both["u"] == least["c"])
    if large:  # larger neighbours go to the least of the neighbourhood
        out = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # the smaller neighbours and the node itself go to the least of them
        out = near.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the smallest node.

    Loops, repeated and null edges count for nothing; without edges the result is empty.
    """
    pairs = edges.filter(F.col(a) != F.col(b))
    now = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, before = materialize(now, "components"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        most = state[0]  # no node has more edges than there are
        if most > EDGES:  # stars grow around the lesser ends
            most = now.groupBy("v").count().agg(F.max("count")).first()[0]
        now, before = materialize(_star(_star(now, True, most), False, most), "components"), state
    # at the end every edge leads from a node to the least of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
