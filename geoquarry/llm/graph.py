"""Connected components by alternating stars."""

from pyspark.sql import functions as F

from geoquarry.session import reliable_checkpoint


def components(edges):
    """Each node of the undirected ``edges`` (a, b) that is not the least of its component, with that least node.

    Every round hangs the larger neighbours of each node on its least neighbour
    (large star), then the smaller ones (small star), until nothing changes; the
    number of rounds grows with the logarithm of the longest path.  A node's
    neighbours are combined before they are shuffled, and never gathered; each
    round is checkpointed, and the driver sees a count and a checksum.
    """
    now = reliable_checkpoint(_clean(edges.select("a", "b")))
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = _clean(both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")))
        lower = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(lower, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            lower.select(F.col("k").alias("a"), F.col("m").alias("b"))
        )
        now = reliable_checkpoint(_clean(small))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now


def _clean(edges):
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
