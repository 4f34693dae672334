"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a join and an aggregate over edges; nothing is collected. Each
round's edges are written to the shared folder, so lineage stays short and an
executor may be lost at any time. Hubs, which the steps themselves make of
large components, are dealt over several tasks by ``join_by_key`` once there
are so many edges that a hub could be too much for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import Written, join_by_key

#: Edges (two numbers each) that one task takes, so that hubs need no care.
FEW = 1_000_000


def _star(both: DataFrame, total: int, larger: bool, work: Written) -> DataFrame:
    """Link neighbours of each node to the least node of its neighbourhood; ``both`` has each edge from u to v."""
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n_rows"))
    if total > FEW:
        met = join_by_key(both, (least := work.table(least, "least")), ["u"], total)
    else:
        met = both.join(least.drop("n_rows"), "u")
    out = met.where(F.col("v") > F.col("u") if larger else F.col("v") <= F.col("u"))
    linked = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        linked = linked.unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
    return linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, work: Written) -> DataFrame:
    """``edges`` (u, v bigint) -> (node, component): component is the least node reachable.

    Self-links and repeated links are ignored; nodes without a link are absent.
    The tables of finished rounds are dropped.
    """
    now = work.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, total = None, now.count()
    while total:
        steps = Written(work.spark)
        turned = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(turned, 2 * total, True, steps)
        if total > FEW:
            large = steps.table(large, "edges")
        now = work.table(_star(large, total, False, steps), "edges")
        steps.drop()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark, total = seen, seen[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
