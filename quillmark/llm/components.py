"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import cut, spread_join


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """The edges u, v with m of ``least``; nodes with many edges are dealt over several tasks."""
    if total < 100_000:
        return edges.join(least.drop("n"), "u")
    return spread_join(edges, least.drop("n"), ["u"], least.select("u", "n"), ["v"])


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges``: columns a, b (long). Returns node, component. Alternating large-star and
    small-star rounds; each is two shuffles of the edge list, which only ever shrinks to one
    edge per node, and is written to the shared folder. No edge reaches the driver: it sees a
    count and a checksum per round. Null ends are ignored; an empty list gives no rows.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark.n == 0 or (mark.n, mark.x) == seen:
            break
        seen = (mark.n, mark.x)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        # every larger neighbour of u goes to the least node near u
        large = _with_least(both.where("v > u"), least, mark.n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hop = _with_least(large, least, mark.n)
        now = cut(
            hop.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
