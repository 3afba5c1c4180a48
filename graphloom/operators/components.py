"""Connected components of an undirected edge table (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Large-star and small-star steps alternate until the edge table stops changing.  Each
    step is one aggregate (combined on the map side) and one join that adaptive execution
    may split, so a node with very many edges never meets in one task.  Rounds grow with
    the logarithm of the graph's diameter.  Null ends and self loops are ignored; an empty
    table gives an empty result.  Edges are never brought to the driver, only their count
    and a checksum.
    """
    kind = edges.schema[a].dataType
    now = materialize(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .where("u is not null and v is not null")
        .distinct(),
        "edges",
    )
    seen = now.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    cur, before, state = now.where("u < v"), None, ()
    while state != before:
        before = state
        nxt = materialize(_small_star(_large_star(cur)), "stars")
        state = tuple(nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        release(cur)
        cur = nxt
    # Converged: every edge points from a node to its component's smallest node.
    roots = cur.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return seen.join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").cast(kind).alias("component")
    )


def joined_components(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` (node, component) after more ``edges`` (a, b): only components that these touch are worked on."""
    ends = edges
    for c in ("a", "b"):
        of = comps.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        ends = ends.join(of, c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    merged = materialize(connected_components(ends, "of_a", "of_b"), "merged")
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = comps.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = merged.join(comps.select("node"), "node", "left_anti").select("node", "component")
    return known.unionAll(fresh)


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (
        both.where("v > u")
        .join(low, "u")
        .select(F.col("m").alias("u"), "v")
        .where("u < v")
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    low = e.groupBy("v").agg(F.min("u").alias("m"))
    kept = low.select(F.col("m").alias("u"), "v")
    moved = e.join(low, "v").where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return kept.unionAll(moved).where("u < v").distinct()
