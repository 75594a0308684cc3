"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlspike.scratch import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): each node of an edge with the smallest node it can reach.

    Large-star links every larger neighbour of a node to the smallest one, small-star does so
    for the smaller neighbours; both keep the components, and after O(log^2 n) rounds each is a
    star around its smallest node. Both are a grouped minimum with map-side combination and a
    join, so a node with very many edges never lies in one group. Self loops and null ends add
    nothing; an empty edge list gives an empty result. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = (
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    pairs = pairs.where(F.col("a").isNotNull())
    now = scratch.save(pairs, "edges")
    before = None
    for _ in range(max_rounds):
        stars = _small_star(_large_star(now))
        nxt = scratch.save(stars, "edges")
        mark = _fingerprint(nxt)
        scratch.drop(now)
        now = nxt
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    larger = pairs.select(F.col("b").alias("n"), F.col("a").alias("v"))
    return larger.join(low, "n").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    low = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _fingerprint(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]
