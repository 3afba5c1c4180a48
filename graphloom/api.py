"""The eight questions that a graph answers, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.build import Graph
from graphloom.functions import text as X
from graphloom.functions.paths import owner
from graphloom.operators import narrow, rank, traverse, vectors
from graphloom.schema import DEFAULT_HOPS, DEFAULT_MIN_SCORE, DIMENSIONS, LIST_PREVIEW


class GraphApi:
    def __init__(self, graph: Graph, built_at=None):
        self.graph, self.built_at = graph, built_at

    def document_details(self, path: str) -> DataFrame:
        """One row: format, size, metrics, entities and clusters of a document, and whether it is stale."""
        g = self.graph
        mine = g.documents.where(F.col("path") == path)
        entities = g.entities.where(F.col("doc_path") == path).groupBy(F.col("doc_path").alias("path")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "type", "name", "start_line", "end_line"))).alias("entities"))
        groups = g.clusters.where(F.array_contains("members", path)).agg(F.sort_array(F.collect_list("cluster_id")).alias("clusters"))
        stale = F.coalesce(F.col("updated_at") > F.lit(self.built_at), F.lit(False)) if self.built_at else F.lit(False)
        return mine.join(g.metrics, "path", "left").join(entities, "path", "left").join(F.broadcast(groups), F.lit(True), "left").withColumn("stale", stale)

    def document_links(self, path: str) -> DataFrame:
        """Links from and to a document or anything in it; links of packages do not count."""
        path = path.strip()
        both = self.graph.links
        out = both.where(owner(F.col("source_id")) == path).select(F.lit("out").alias("direction"), *both.columns)
        return out.unionByName(both.where(owner(F.col("target_id")) == path).select(F.lit("in").alias("direction"), *both.columns))

    def documents_by_format(self, name: str) -> DataFrame:
        g = self.graph
        counts = g.entities.groupBy(F.col("doc_path").alias("path")).agg(F.count("*").alias("n"))
        mine = g.documents.where(F.lower("format") == name.lower())
        return mine.join(counts, "path", "left").select("path", "size", F.coalesce("n", F.lit(0)).alias("n_entities")).orderBy("path")

    def entities_by_type(self, kind: str) -> DataFrame:
        return self.graph.entities.where(F.lower("type") == kind.lower()).select("name", "entity_id", "doc_path", "start_line", "end_line").orderBy("doc_path", "start_line", "entity_id")

    def clusters(self, kind: str = "") -> DataFrame:
        """Clusters by kind, largest first, with the first members."""
        c = self.graph.clusters
        if kind:
            c = c.where(F.lower("kind") == kind.lower())
        order = F.when(F.col("kind") == "directory", 0).when(F.col("kind") == "module", 1).otherwise(2)
        return c.select("cluster_id", "kind", "name", "size", X.preview(F.col("members"), LIST_PREVIEW).alias("preview")).orderBy(order, F.desc("size"), "name")

    def cluster(self, cluster_id: str) -> DataFrame:
        """The members of a cluster and their formats."""
        members = self.graph.clusters.where(F.col("cluster_id") == cluster_id).select(F.explode("members").alias("path"))
        return members.join(self.graph.documents.select("path", "format"), "path", "left").select("path", F.coalesce("format", F.lit("unknown")).alias("format")).orderBy("path")

    def graph_metrics(self, max_results: int = 0) -> DataFrame:
        return rank.ranked(self.graph.metrics, max_results or None)

    def narrowed_context(
        self, entry: str, query: str, max_hops: int = DEFAULT_HOPS, min_score: float = DEFAULT_MIN_SCORE, source_type: str | None = None, exclude: list[str] = (),
        max_tokens: int = 0, embedder=None,
    ) -> DataFrame:
        """Snippets of what is near an entry and a query: ``path, nth, snippet, tokens``."""
        g = self.graph
        if g.vectors is None:
            raise ValueError("the graph has no vectors: build it with embeddings")
        if traverse.entry_documents(g.documents, entry).isEmpty():
            raise ValueError(f"no document or directory is called {entry!r}")
        size = g.vectors.select(F.size("embedding")).first()
        embedder = embedder or vectors.hashing_embedder(size[0] if size else DIMENSIONS)
        at = [float(x) for x in embedder([query])[0]]
        chosen = narrow.selected(g.documents, g.links, g.vectors, entry, at, max_hops, min_score, source_type, list(exclude), g.package_files)
        near = g.vectors.select("node_id", vectors.cosine(F.col("embedding"), F.array(*map(F.lit, at))).alias("score"))
        parts = narrow.snippets(g.entities, g.contents, near)
        whole = g.contents.select("path", F.lit(1).alias("nth"), F.col("content").alias("snippet")).join(parts.select("path").distinct(), "path", "left_anti")
        blocks = chosen.join(parts.unionByName(whole), "path")
        order = [F.desc("is_entry"), F.coalesce("score", F.lit(0.0)).desc(), F.col("path"), F.col("nth")]
        return narrow.within_budget(blocks, max_tokens, order)
