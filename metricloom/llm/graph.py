"""Connected components by alternating star contraction, with every step a join or aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import dropped, stored


def _smallest(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Smallest ``value`` per ``key``.

    The rebalance puts an exchange between this aggregation and the join that
    follows, so that adaptive execution can split a hot key of that join.
    """
    return (
        pairs.groupBy(F.col(key).alias("_key"))
        .agg(F.min(value).alias("_low"))
        .hint("rebalance")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every node's larger neighbours to the smallest of its neighbourhood."""
    lows = _smallest(
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
            edges.select(F.col("lo").alias("node"), F.col("lo").alias("other"))
        ),
        "node",
        "other",
    )
    return (
        edges.join(lows, edges["lo"] == lows["_key"])
        .select("hi", F.col("_low").alias("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node's smaller neighbours, and itself, to the smallest of them."""
    lows = _smallest(edges, "hi", "lo")
    joined = edges.join(lows, edges["hi"] == lows["_key"])
    return (
        joined.select(
            F.explode(
                F.array(
                    F.struct(F.col("hi"), F.col("_low").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("_low").alias("lo")),
                )
            ).alias("e")
        )
        .select("e.hi", "e.lo")
        .filter("hi > lo")
        .distinct()
    )


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every larger node has one edge and no centre hangs on another."""
    degrees = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    centres = edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    bad = (
        degrees.unionByName(centres)
        .groupBy("node")
        .agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        .filter("up > 1 or (up > 0 and down > 0)")
    )
    return bad.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge.

    ``edges`` holds two BIGINT columns, ``a`` and ``b``, in any order and with
    any repeats; rows with a null or with a = b are no edges. The component is
    its smallest node. Each round is written to the shared scratch folder; the
    number of rounds grows with the logarithm of the number of nodes.
    """
    edges = stored(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "edges",
    )
    while not _is_forest_of_stars(edges):
        contracted = stored(_small_star(_large_star(edges)), "edges")
        dropped(edges)
        edges = contracted
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
