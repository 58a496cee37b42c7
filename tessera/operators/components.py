"""Connected components of an undirected graph, by contraction: hook to the smallest neighbour, jump to the root, relabel edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import dropped, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """One row ``(node, component)`` for each node of ``edges``; component is the smallest node reachable.

    Each round hooks every node that still has edges to its smallest neighbour (a map-side-combined minimum), follows the
    hooks to their roots by pointer jumping, and relabels the edges by the roots. Edges within a tree are gone then, so
    rounds get smaller fast, and a group of very many edges costs its size once. Every step ends in a written table. Self loops give a
    node alone; edges with a null end are ignored; repeated edges count once. Raises RuntimeError if ``rounds`` do not suffice.
    """
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    pairs = written(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    live = pairs.where("a <> b")
    for _ in range(rounds):
        ends = live.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))
        up = _rooted(written(ends.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("label")), "hooks"), rounds)
        left, right = up.toDF("a", "x"), up.toDF("b", "y")
        fresh = live.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        before, last = live, found
        live = written(fresh, "edges")
        root = up.toDF("component", "root")
        found = written(last.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        dropped(before, last, up)
        if not live.limit(1).count():
            dropped(pairs, live)
            return found
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def _rooted(hooks: DataFrame, rounds: int) -> DataFrame:
    """``(node, label)`` with every node's label its root: chains of hooks shrink to half at each jump."""
    for _ in range(rounds):
        up = hooks.toDF("label", "above")
        jumped = written(hooks.join(up, "label").select("node", F.col("above").alias("label"), (F.col("above") != F.col("label")).alias("moved")), "hooks")
        dropped(hooks)
        hooks = jumped.select("node", "label")
        hooks._tessera_path = jumped._tessera_path
        if not jumped.where("moved").limit(1).count():
            return hooks
    raise RuntimeError(f"hooks have not settled after {rounds} jumps")
