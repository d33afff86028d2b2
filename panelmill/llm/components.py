"""Connected components of a link table by alternating star contraction (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` with a > b; one row or fewer for each, as the edge to the least neighbour stays where it is."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges with a > b are stars: each a has one b, and no b is an a. A round would change nothing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b): every node of ``links`` (a, b long, a != b) that is not the least of its component, with
    that least node. No links: no rows. Each round is a few aggregations and two skew-safe joins."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), "cc-edges")
    for _ in range(most_rounds):
        nxt = written(_small_star(_large_star(edges)), "cc-edges")
        drop_written(edges)
        edges = nxt
        if _settled(edges):
            return edges
    raise RuntimeError("star contraction did not settle")
