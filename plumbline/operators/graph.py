"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import tables


def _min_per_key(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component), a table: the smallest id reachable from each id that occurs in an edge.

    Alternating star contraction: every round points all neighbours of a node
    at the least of them (first the larger neighbours, then the smaller), so
    chains shrink by a factor each round; rounds go on until nothing moves. Minima are pre-aggregated and joined
    back, so a node with very many links isn't gathered in a task. Self-loops and nulls are
    dropped; repeated edges are one edge.
    """
    spark = edges.sparkSession
    now = tables.materialise(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "edges")
    mark = None
    while True:
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (got.n, got.h):
            break
        mark = (got.n, got.h)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _min_per_key(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = _min_per_key(large)
        small = large.join(down, "u").select("u", "v", "m")
        # a node and its larger neighbours all point at the least
        nxt = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        nxt = tables.materialise(nxt, "edges")
        tables.drop_tables(spark, now)
        now = nxt
    # once nothing moves, every edge ends in its component's least id
    out = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out = tables.materialise(out, "components")
    tables.drop_tables(spark, now)
    return out
