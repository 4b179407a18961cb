"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that the session names; a folder of this machine only in local mode."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to the least node that it sees."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another, root being the component's least node.

    ``edges`` are (a, b) of any type that has an order, in either direction, repeated or not; rows with a null
    and loops say nothing. The rounds grow with the logarithm of the nodes; each is checkpointed, and a hub is
    joined by key, not gathered.
    """
    pairs = edges.dropna(subset=["a", "b"]).filter("a <> b")
    stars = kept(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = stars.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(stars.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        open_ = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("root").alias("root")).filter("child > 1 or child = 1 and root = 1")
        if open_.isEmpty():
            break
        stars = kept(_small_star(_large_star(stars)))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
