"""From a source tree to a graph: scan, extract, link, group, rank, embed and write."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import cluster, coupling, extract, links, rank, vectors
from graphloom.plans.shared import materialize
from graphloom.schema import COMMIT_LIMIT
from graphloom.sources import git, snapshot, tree


@dataclass
class BuildOptions:
    """What to build and where to write it; ``output`` is a folder of Parquet versions or a ``.json`` file."""

    source: str = "."
    output: str | None = None
    exclude: list[str] = field(default_factory=list)
    ignore_files: list[str] = field(default_factory=list)
    changed_only: bool = False
    git: bool = True
    git_limit: int = COMMIT_LIMIT
    embed: bool = False
    dimensions: int = 384
    embedder: object | None = None


@dataclass
class Graph:
    """The tables of a graph; ``links`` has co-change links, which clusters and ranks do not use."""

    documents: DataFrame
    entities: DataFrame
    links: DataFrame
    package_files: DataFrame
    packages: DataFrame
    clusters: DataFrame
    metrics: DataFrame
    contents: DataFrame
    vectors: DataFrame | None = None
    built_at: object | None = None

    def tables(self) -> dict[str, DataFrame]:
        """What a snapshot holds."""
        spark = self.documents.sparkSession
        built = spark.range(1).select(F.lit(snapshot.SCHEMA_VERSION).alias("schema_version"), F.current_timestamp().alias("built_at"))
        hubs = self.metrics.agg(F.count_if("is_hub").alias("hub_count"))
        named = ("documents", "entities", "links", "packages", "clusters", "metrics")
        return {n: getattr(self, n) for n in named} | {"snapshot": built.join(hubs, F.lit(True)), "contents": self.contents} | ({"vectors": self.vectors} if self.vectors is not None else {})


def analyze(documents: DataFrame, entities: DataFrame, parsed: DataFrame, contents: DataFrame, commit_files: DataFrame | None = None) -> Graph:
    """All passes over extracted tables."""
    members = materialize(links.package_of(documents, entities), "members")
    imported = materialize(links.file_imports(documents, entities), "imports")
    of_packages = materialize(links.package_imports(entities, members), "package_imports")
    core = [
        links.implements(entities),
        links.documented_by_path(documents, entities),
        links.normalized(parsed),
        links.part_of(members),
        of_packages,
        imported,
        links.references(entities, imported.select(F.col("source_id").alias("doc_path"), F.col("target_id").alias("target"))),
    ]
    all_links = core[0]
    for other in core[1:]:
        all_links = all_links.unionByName(other)
    all_links = materialize(all_links, "links")
    files = members.select("pkg_key", "path")
    edges = materialize(coupling.coupling_edges(all_links, documents, files), "edges")
    grouped = cluster.directory_members(documents).unionByName(cluster.module_members(members)).unionByName(cluster.network_members(cluster.communities(edges)))
    ranks = rank.pagerank(edges)
    metrics = coupling.degrees(edges, documents).join(ranks, F.col("path") == F.col("node"), "left")
    metrics = materialize(rank.hubs(metrics.withColumn("pagerank", F.coalesce("rank", F.lit(0.0))).drop("node", "rank")), "metrics")
    if commit_files is not None:
        present = commit_files.join(documents.select("path"), "path", "left_semi")
        all_links = materialize(all_links.unionByName(links.cochange(present.select("commit", "path"))), "links")
    return Graph(documents, entities, all_links, files, links.packages(members, of_packages), materialize(cluster.clusters(grouped), "clusters"), metrics, contents)


def _stored_vectors(spark: SparkSession, options: BuildOptions) -> DataFrame | None:
    """Vectors of the last snapshot, where it has some of the length that is asked for."""
    if not options.output or options.output.endswith(".json"):
        return None
    try:
        stored = snapshot.read(spark, options.output).get("vectors")
    except Exception:  # no snapshot yet
        return None
    return None if stored is None else stored.where(F.size("embedding") == options.dimensions)


def build(spark: SparkSession, options: BuildOptions) -> Graph:
    """Scan a tree and build its graph; writes a snapshot where an output is named.

    With ``changed_only``, files that git calls changed are read and laid over the last
    snapshot; without one everything is read.
    """
    root = os.path.abspath(options.source)
    files = tree.read_tree(spark, root, options.exclude, options.ignore_files, options.output)
    old = None
    if options.changed_only and options.output:
        try:
            old = snapshot.read(spark, options.output)
        except Exception:  # no snapshot, or one that cannot be read: everything is built anew
            old = None
    top = git.repository(root) if options.git else None
    states = None
    if top:
        states = spark.createDataFrame([(os.path.relpath(p, root), c) for p, c in sorted(git.status(root).items())], "path string, code string")
    scanned = materialize(files, "files")
    chosen = git.changed_only(scanned, states) if old is not None and states is not None else scanned
    documents, entities, parsed = extract.extract(chosen)
    if old is not None:
        fresh, existing = documents, scanned.select("path")
        kept = old["entities"].join(fresh.select(F.col("path").alias("doc_path")), "doc_path", "left_anti").join(existing.select(F.col("path").alias("doc_path")), "doc_path", "left_semi")
        inner = old["links"].where((F.col("source_type") == "extracted") & F.col("type").isin("calls", "exports", "references"))
        owner = F.substring_index("source_id", "#", 1)
        parsed = parsed.unionByName(inner.join(fresh.select(F.col("path").alias("_p")), owner == F.col("_p"), "left_anti").join(existing.select(F.col("path").alias("_p")), owner == F.col("_p"), "left_semi"))
        documents = snapshot.merge(old["documents"], fresh, existing, "path").select(*fresh.columns)
        entities = entities.unionByName(kept.select(*entities.columns))
    commit_files = None
    if top:
        documents = git.stamped(documents, states, git.head(root))
        prefix = os.path.relpath(root, top)
        commits = git.recent(spark, root, options.git_limit).select(F.col("hash").alias("commit"), F.explode("files").alias("path"))
        if prefix != ".":
            commits = commits.where(F.startswith("path", F.lit(prefix + "/"))).withColumn("path", F.substring("path", len(prefix) + 2, 1 << 20))
        if git.head(root):
            commit_files = commits
    contents = scanned.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    graph = analyze(materialize(documents, "documents"), materialize(entities, "entities"), parsed, contents, commit_files)
    if options.embed:
        payloads = vectors.document_payloads(graph.documents, contents).unionByName(vectors.entity_payloads(graph.entities, contents))
        embedder, stored = options.embedder or vectors.hashing_embedder(options.dimensions), _stored_vectors(spark, options)
        made = vectors.embed(payloads, embedder) if stored is None else vectors.upkeep(stored, payloads, embedder)
        graph.vectors = vectors.check_dimensions(made, options.dimensions)
    if options.output:
        if options.output.endswith(".json"):
            snapshot.to_json({k: v for k, v in graph.tables().items() if k not in ("contents", "vectors")}, options.output)
        else:
            snapshot.write(graph.tables(), options.output)
    return graph
