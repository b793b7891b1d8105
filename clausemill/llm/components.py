"""Connected components by alternating large stars and small stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.shared import discard, saved, scratch

HOT_NODES = 20_000


def components(edges: DataFrame, name: str = "components", most: int = 1000) -> DataFrame:
    """(u, v) edges over any ordered type -> (node, component), component the smallest node reachable.

    Only nodes with an edge appear. Nothing is collected but two numbers a round. Minima are partial aggregates; the edges
    of hot nodes, of which there are fewer than `HOT_NODES`, meet them where they lie. Edge sets shrink or stay at every
    round and rounds are few (of the order of the square of the longest path's logarithm); `most` only stops what
    cannot end, such as edges that change between reads.

    Each step of a round is a table: in one plan a round reads the edges 108 times, and the driver, which plans and tells
    of it anew after each of its stages, takes memory for that.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = _mark(now)
    for _ in range(most):
        if not mark[0]:
            break
        with scratch(now.sparkSession) as s:
            both = now.union(now.select("v", "u"))
            low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-low")
            large = _with_least(both, low, 2 * mark[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = saved(large.where("u <> v").distinct(), f"{name}-large")
            low = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-low")
            small = _with_least(large, low, mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
            after = saved(small.where("u <> v").distinct(), name)
            s.keep(after)
        discard(now.sparkSession, now)
        now, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out._saved_path = now._saved_path
    return out


def _with_least(edges: DataFrame, low: DataFrame, many: int) -> DataFrame:
    """`edges` with m of `low` (u, m, n). Nodes of more edges than many / HOT_NODES are fewer than HOT_NODES: they are broadcast."""
    bound = max(512, many // HOT_NODES)
    if (low.agg(F.max("n")).collect()[0][0] or 0) <= bound:
        return edges.join(low.select("u", "m"), "u")
    met = edges.join(F.broadcast(low.where(F.col("n") > bound).select("u", "m")), "u", "left")
    cold = met.where("m is null").select(*edges.columns).join(low.where(F.col("n") <= bound).select("u", "m"), "u")
    return met.where("m is not null").union(cold.select(*met.columns))


def _mark(edges: DataFrame) -> tuple:
    """Number and a sum of hashes of the edges; equal for equal sets."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    return row[0], row[1]
