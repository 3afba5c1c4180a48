"""The coupling graph: summed link weights between documents, and their degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import owner
from graphloom.schema import MIN_WEIGHT, WEIGHT_SCALE


def expanded(ends: DataFrame, column: str, package_files: DataFrame | None) -> DataFrame:
    """``ends`` with ``{column}_doc``: the owner of a node id, for a package each of its files."""
    if package_files is None:
        return ends.withColumn(f"{column}_doc", owner(F.col(column)))
    files = package_files.select(F.concat(F.lit("package:"), F.col("pkg_key")).alias(column), F.col("path").alias("_file"))
    joined = ends.join(files, column, "left")
    return joined.withColumn(f"{column}_doc", F.coalesce("_file", F.when(~F.startswith(F.col(column), F.lit("package:")), owner(F.col(column))))).drop("_file")


def coupling_edges(links: DataFrame, documents: DataFrame, package_files: DataFrame | None = None, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """``(a, b, w)`` in both directions: tenths of weight summed over links of at least ``min_weight``.

    ``documents`` links, self edges and ends that are no document do not count.
    """
    kept = links.where((F.col("weight") >= min_weight) & (F.col("type") != "documents")).select("source_id", "target_id", "weight")
    ends = expanded(expanded(kept, "source_id", package_files), "target_id", package_files)
    known = documents.select("path").distinct()
    ends = ends.join(known.withColumnRenamed("path", "source_id_doc"), "source_id_doc", "left_semi").join(known.withColumnRenamed("path", "target_id_doc"), "target_id_doc", "left_semi")
    pairs = (
        ends.where("source_id_doc <> target_id_doc")
        .groupBy(F.least("source_id_doc", "target_id_doc").alias("a"), F.greatest("source_id_doc", "target_id_doc").alias("b"))
        .agg(F.sum((F.col("weight") * WEIGHT_SCALE).cast("bigint")).alias("w"))
    )
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def degrees(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """``(path, degree, weighted_degree)`` of every document, weighted degrees in tenths."""
    sums = edges.groupBy("a").agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))
    return documents.select("path").distinct().join(sums, F.col("path") == F.col("a"), "left").select(
        "path", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), F.coalesce("weighted_degree", F.lit(0)).cast("double").alias("weighted_degree")
    )
