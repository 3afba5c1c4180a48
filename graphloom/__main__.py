"""``python -m graphloom``: build, metrics, clusters, visualize and serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from graphloom import config
from graphloom.api import GraphApi
from graphloom.build import BuildOptions, Graph, build
from graphloom.plans import report
from graphloom.session import session
from graphloom.sources import snapshot


def _load(spark, path: str) -> Graph:
    """A graph from a snapshot, with its contents and vectors where it has them."""
    t = snapshot.read(spark, path)
    files = t["packages"].select("pkg_key", F.explode("files").alias("path"))
    contents = t.get("contents")
    if contents is None:
        contents = spark.createDataFrame([], "path string, content string")
    graph = Graph(t["documents"], t["entities"], t["links"], files, t["packages"], t["clusters"], t["metrics"], contents, t.get("vectors"))
    graph.built_at = t["snapshot"].first()["built_at"] if "snapshot" in t else None
    return graph


def _rows(df) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().collect()]


TOOLS = {
    "get_document_details": lambda a, p: a.document_details(p["path"]),
    "get_document_links": lambda a, p: a.document_links(p["path"]),
    "list_documents_by_format": lambda a, p: a.documents_by_format(p["format"]),
    "find_entities_by_type": lambda a, p: a.entities_by_type(p["type"]),
    "get_narrowed_context": lambda a, p: a.narrowed_context(
        p["entryPath"], p["searchQuery"], int(p.get("maxHops", 1)), float(p.get("minScore", 0.65)), p.get("sourceType"), p.get("exclude", []), int(p.get("maxTokens", 0))
    ),
    "list_clusters": lambda a, p: a.clusters(p.get("kind", "")),
    "get_cluster": lambda a, p: a.cluster(p["id"]),
    "get_graph_metrics": lambda a, p: a.graph_metrics(int(p.get("maxResults", 0))),
}


def serve(api: GraphApi, lines, out) -> None:
    """Answer JSON-RPC requests, one a line; a failing tool gives an error and not an end."""
    for line in lines:
        if not line.strip():
            continue
        request: dict = {}
        try:
            request = json.loads(line)
            if request["method"] == "tools/list":
                result = {"tools": [{"name": n} for n in TOOLS]}
            elif request["method"] == "tools/call":
                result = {"rows": _rows(TOOLS[request["params"]["name"]](api, request["params"].get("arguments", {})))}
            else:
                result = {}
            answer = {"result": result}
        except Exception as e:  # the caller is told and the server goes on
            answer = {"error": {"code": -32603, "message": f"{type(e).__name__}: {e}"[:500]}}
        out.write(json.dumps({"jsonrpc": "2.0", "id": request.get("id") if isinstance(request, dict) else None} | answer) + "\n")
        out.flush()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("source", nargs="?", default=".")
    b.add_argument("--output", default="graph")
    b.add_argument("--exclude", action="append", default=[])
    b.add_argument("--ignore-file", action="append", default=[])
    b.add_argument("--changed-only", action="store_true")
    b.add_argument("--no-git", action="store_true")
    b.add_argument("--git-limit", type=int, default=50)
    b.add_argument("--embed", action="store_true")
    b.add_argument("--dimensions", type=int)
    for name in ("metrics", "clusters", "visualize", "serve"):
        s = sub.add_parser(name)
        s.add_argument("--file", default="graph")
        if name == "clusters":
            s.add_argument("--kind", default="")
        if name == "metrics":
            s.add_argument("--limit", type=int, default=0)
        if name == "visualize":
            s.add_argument("--html", default="graph.html")
            s.add_argument("--report", default="GRAPH_REPORT.md")
    a = p.parse_args(argv)
    spark = session()
    if a.command == "build":
        source = a.source.removesuffix("/...") or "."
        g = build(spark, BuildOptions(source, a.output, a.exclude, a.ignore_file, a.changed_only, not a.no_git, a.git_limit, a.embed, config.resolve({"dimensions": a.dimensions}, source).dimensions))
        print(f"{g.documents.count()} documents, {g.entities.count()} entities, {g.links.count()} links")
        return 0
    graph = _load(spark, a.file)
    api = GraphApi(graph, graph.built_at)
    if a.command == "metrics":
        for r in api.graph_metrics(a.limit).collect():
            print(f"{'*' if r['is_hub'] else ' '} {r['path']}\t{r['degree']}\t{r['weighted_degree']:g}\t{r['pagerank']:.6f}")
    elif a.command == "clusters":
        for r in api.clusters(a.kind).collect():
            print(f"{r['cluster_id']}\t{r['size']}\t{r['preview']}")
    elif a.command == "visualize":
        with open(a.html, "w", encoding="utf-8") as f:
            f.write(report.page(graph.documents, graph.links, graph.metrics))
        with open(a.report, "w", encoding="utf-8") as f:
            f.write(report.markdown(graph.documents, graph.links, graph.metrics, graph.clusters))
    else:
        serve(api, sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
