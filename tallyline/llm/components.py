"""Connected components of a graph that no task holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (two columns of comparable ids, any order, repeats allowed).

    ``root`` is the smallest node that can be reached. Each round hooks every node to the smallest node around it
    (large star, then small star) and is written to the shared folder, so a lost executor costs one round and the plan
    never grows. Rounds grow with the logarithm of the longest chain. The smallest neighbour is an aggregate with
    partial results on the sending side; a node with very many links meets its own row in a join that adaptive
    execution may split. Null ids and self-links are dropped; no edges give no rows. Raises if ``max_rounds`` end
    before the links are stable, rather than return a wrong answer.
    """
    left, right = edges.columns[:2]
    links = (
        edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    links = materialize(links, "links")
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: larger neighbours of each node hang on the smallest node around it.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: each node and its smaller neighbours hang on the smallest of those.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("nodes")
        ).first()
        now = (state["n"], state["h"])
        if now == before:
            roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError(f"links are not stable after {max_rounds} rounds")
