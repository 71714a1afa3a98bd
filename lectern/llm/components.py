"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import store


def stars(pairs: DataFrame) -> DataFrame:
    """For each (u, v): v and the smallest of u and its partners, and the same for u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def fingerprint(edges: DataFrame):
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
    return tuple(row)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) of every id of the undirected `edges`; loops and nulls drop out.

    Each round links every id to smaller ones only (large star, then small star); the number of rounds grows with
    the logarithm of the longest chain. A round is a few joins over the edges, written to the shared folder; of a
    hub's edges only the minimum is gathered, so no task holds a component.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = store(pairs, "edges")
    seen = fingerprint(pairs)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = stars(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        pairs = store(small.where("u <> v").distinct(), "edges")
        now = fingerprint(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
