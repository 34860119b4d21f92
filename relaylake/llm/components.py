"""Connected components of a graph of pairs, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of ``edges`` but the roots, with the least node of its component.

    Each round moves only (node, node) pairs, is written to the shared folder
    and reread, and the one before deleted; the rounds grow with the logarithm of the largest diameter.
    Edges of a node with itself and null ends are left out.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    state = None
    for _ in range(MAX_ROUNDS):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.select("u", "v", least.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = F.min("v").over(Window.partitionBy("u"))
        seen = large.select("u", "v", least.alias("m"))
        small = seen.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(seen.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, materialise(small)
        discard(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("components did not settle")
