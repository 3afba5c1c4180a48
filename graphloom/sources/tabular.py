"""Document graphs read from relational tables: parts, suppliers, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import links as L
from graphloom.plans.shared import materialize
from graphloom.schema import EXTRACTED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_path():
    return F.concat(F.lit("part/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("/"), F.col("p_partkey").cast("string"))


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents ``(path, format, size)`` below a directory for each brand."""
    return table(spark, sf_dir, "part").select(part_path().alias("path"), F.split("p_type", " ")[0].alias("format"), F.col("p_size").cast("bigint").alias("size"))


def basket_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are ordered together, as files that change together."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), part_path().alias("path"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), "l_partkey").join(parts, "l_partkey")
    return L.cochange(lines.select("commit", "path"))


def basket_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupling edges ``(a, b, w)`` of the basket graph, written once for the operators above it."""
    from graphloom.operators.coupling import coupling_edges

    return materialize(coupling_edges(basket_links(spark, sf_dir), part_documents(spark, sf_dir)), "baskets")


def supplier_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents in packages, one for each nation: ``(path, pkg_key, name, format)``."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.concat(F.lit("region/"), F.col("r_name"), F.lit("/nation/"), F.col("n_name"))
    return named.select(F.concat(key, F.lit("/supplier/"), F.col("s_suppkey").cast("string")).alias("path"), key.alias("pkg_key"), F.col("n_name").alias("name"), F.lit("supplier").alias("format"), "s_suppkey")


def supply_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplies`` links from suppliers to parts, weighted by how often, extracted from two deliveries on."""
    nodes = supplier_nodes(spark, sf_dir).select("s_suppkey", F.col("path").alias("source_id"))
    parts = table(spark, sf_dir, "part").select("p_partkey", part_path().alias("target_id"))
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    named = pairs.join(nodes, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    many = F.col("n") >= 2
    return named.select(
        "source_id", "target_id", F.lit("supplies").alias("type"), F.least(F.round(F.lit(0.3) + 0.1 * F.col("n"), 6), F.lit(1.0)).alias("weight"),
        F.when(many, EXTRACTED).otherwise("inferred").alias("source_type"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and links of pages as entities ``(doc_path, type, name)``."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("doc_path"), "html")
    found = lambda kind, pattern: pages.select("doc_path", F.lit(kind).alias("type"), F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("name"))
    return found("heading", r"<h1>([^<]*)</h1>").unionByName(found("link", r'<a href="([^"]*)"')).unionByName(found("title", r"<title>([^<]*)</title>"))
