"""Connected components by alternating star contraction, as DataFrame joins.

Each round is a few shuffles over the links that remain; it ends in a written table. Hubs, which may hold most links, are
met by broadcast (see ``join_hot``). No link or component passes through the driver, which reads a few numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stored


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node's larger neighbours are linked to the least of the node and its neighbours; ``n``: rows of ``edges``."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    met = join_hot(both.where("b > a"), least, "a", 2 * n)
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of these."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    own = least.select("a", F.col("m").alias("b"))
    met = join_hot(edges, least, "a", n).where("b > m")
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Columns ``a`` and ``b`` (long, links in either direction, repeats and self-links allowed) to
    ``node, root``: every node that has a link to another one, with the smallest node reachable.

    An empty table gives an empty table; null ends are dropped.
    """
    edges = stored(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        wide = stored(_large_star(edges, before[0]), "stars")
        edges = stored(_small_star(wide, wide.count()), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
