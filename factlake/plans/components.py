"""Connected components of an edge table, without driver-side edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.storage import discard, written


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Label every node that has an edge with the smallest id it can reach: ``(node, component)``.

    Alternates two star steps. The large step links each node's larger neighbours to the smallest
    neighbour, the small step its smaller ones; ids must be comparable and not null. Each half step
    is one aggregation and one join, so a hub's neighbours are spread by the join, and the number
    of rounds grows with the logarithm of the diameter. Self-loops and repeated edges are ignored;
    an empty table gives an empty result. Rounds go on until none changes anything.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _fingerprint(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, written(low.select("u", F.col("m").alias("v")).unionByName(rest).distinct(), "edges")
        state, before = _fingerprint(e), state
        discard(last)
        if state == before:
            labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return labels.unionByName(roots)


def _fingerprint(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 40))).first())
