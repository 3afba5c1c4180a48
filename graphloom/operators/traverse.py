"""Reaching documents from an entry, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import excluded
from graphloom.operators.coupling import expanded
from graphloom.plans.shared import materialize
from graphloom.schema import DEFAULT_HOPS, EXTRACTED, MIN_WEIGHT


def entry_documents(documents: DataFrame, entry: str) -> DataFrame:
    """The document of that path, or all documents below that directory."""
    bare = entry.rstrip("/")
    exact = documents.where(F.col("path") == entry).select("path")
    below = documents.where(F.startswith(F.col("path"), F.lit(bare + "/"))).select("path")
    return exact if not exact.isEmpty() else below


def reachable(
    start: DataFrame, links: DataFrame, documents: DataFrame, hops: int = DEFAULT_HOPS, source_type: str | None = None, exclude: list[str] | None = None,
    package_files: DataFrame | None = None, min_weight: float = MIN_WEIGHT,
) -> DataFrame:
    """``(path, hop)``: least number of steps over links in either direction from ``start`` (path).

    A round joins the last level with the edges and drops what was seen.
    """
    kept = links.where(F.col("weight") >= min_weight)
    if source_type:
        kept = kept.where(F.coalesce(F.nullif("source_type", F.lit("")), F.lit(EXTRACTED)) == source_type)
    ends = expanded(expanded(kept.select("source_id", "target_id"), "source_id", package_files), "target_id", package_files)
    one = ends.select(F.col("source_id_doc").alias("a"), F.col("target_id_doc").alias("b")).where("a <> b")
    edges = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = edges.join(documents.select(F.col("path").alias("b")), "b", "left_semi")
    if exclude:
        edges = edges.where(~excluded(F.col("b"), exclude))
        start = start.where(~excluded(F.col("path"), exclude))
    edges = materialize(edges, "steps")
    seen = level = start.select("path").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, max(hops, 1) + 1):
        step = edges.join(level.select(F.col("path").alias("a")), "a", "left_semi").select(F.col("b").alias("path")).distinct()
        level = materialize(step.join(seen, "path", "left_anti").withColumn("hop", F.lit(hop)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
