"""Connected components of large graphs by alternating star contractions.

Each round hangs every node's larger neighbours on its smallest one (large star), then every node's
smaller neighbours (small star); rounds grow with the logarithm of the longest path.  All steps are
minimum aggregates and equi-joins, so no node's neighbourhood is gathered in one place, and a hub's join
is split by adaptive execution.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialized


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long, self-links allowed) -> (node, root): root is the smallest node reachable.

    Nodes without an edge to another node are not returned.  Empty in, empty out.
    """
    spark = edges.sparkSession
    u, v = F.col("u"), F.col("v")
    pairs = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    pairs, path = materialized(pairs, "links")
    seen = None
    while True:
        mark = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == seen or mark.n == 0:
            return pairs.select(u.alias("node"), v.alias("root"))
        seen = (mark.n, mark.h)
        both = pairs.union(pairs.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(u.alias("k"), F.least(u, F.col("m")).alias("m"))
        large = both.where(v > u).join(least, u == F.col("k")).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(u.alias("k"), "m")
        small = large.join(low, u == F.col("k")).select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(u.alias("a"), F.col("m").alias("b")), F.struct(v.alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where(u != v).distinct()
        pairs, new = materialized(small, "links")
        discard(spark, path)
        path = new
