"""Views for people: node and link tables, a Markdown report and one self-contained page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import owner
from graphloom.schema import MIN_WEIGHT, REPORT_PREVIEW, REPORT_TOP


def numbered(documents: DataFrame) -> DataFrame:
    """``(path, idx)``: places among the sorted paths, from 0.

    Paths are dealt by range and numbered within each part; only the parts' counts are
    summed in one task.
    """
    dealt = documents.select("path").repartitionByRange("path").withColumn("part", F.spark_partition_id())
    from graphloom.plans.shared import materialize

    dealt = materialize(dealt, "numbered")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    return dealt.withColumn("nth", nth).join(F.broadcast(before), "part").select("path", (F.col("before") + F.col("nth") - 1).cast("bigint").alias("idx"))


def view_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """The heaviest of parallel links between two documents, of at least the least weight."""
    ends = links.where(F.col("weight") >= MIN_WEIGHT).select(owner(F.col("source_id")).alias("source"), owner(F.col("target_id")).alias("target"), "type", "source_type", "weight").where("source <> target")
    known = documents.select("path")
    ends = ends.join(known.withColumnRenamed("path", "source"), "source", "left_semi").join(known.withColumnRenamed("path", "target"), "target", "left_semi")
    best = ends.groupBy("source", "target").agg(F.max(F.struct("weight", "type", "source_type")).alias("m"))
    return best.select("source", "target", F.col("m.type").alias("type"), F.col("m.source_type").alias("source_type"), F.col("m.weight").alias("weight"))


def markdown(documents: DataFrame, links: DataFrame, metrics: DataFrame, clusters: DataFrame, top: int = REPORT_TOP) -> str:
    """A report of formats, links, hubs, most coupled documents and clusters; only bounded tables reach the driver."""
    out = ["# Graph report", "", "## Formats", "", "| format | documents | bytes |", "| --- | --- | --- |"]
    for r in documents.groupBy("format").agg(F.count("*").alias("n"), F.sum("size").alias("b")).orderBy(F.desc("n"), "format").collect():
        out.append(f"| {r['format']} | {r['n']} | {r['b'] or 0} |")
    out += ["", "## Links", "", "| type | provenance | links |", "| --- | --- | --- |"]
    for r in links.groupBy("type", "source_type").count().orderBy(F.desc("count"), "type", "source_type").collect():
        out.append(f"| {r['type']} | {r['source_type']} | {r['count']} |")
    for title, rows in (
        ("Hubs", metrics.where("is_hub").orderBy(F.desc("pagerank"), "path")),
        ("Most coupled documents", metrics.where("degree > 0").orderBy(F.desc("weighted_degree"), "path")),
    ):
        out += ["", f"## {title}", "", "| path | degree | weighted degree | rank |", "| --- | --- | --- | --- |"]
        out += [f"| {r['path']} | {r['degree']} | {r['weighted_degree']:g} | {r['pagerank']:.6f} |" for r in rows.limit(top).collect()]
    out += ["", "## Clusters", ""]
    shown = clusters.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("size"), "name"))).where(F.col("nth") <= top)
    for r in shown.select("kind", "name", "size", F.slice("members", 1, REPORT_PREVIEW).alias("head"), "nth").orderBy("kind", "nth").collect():
        more = r["size"] - len(r["head"])
        out.append(f"- **{r['kind']}:{r['name']}** ({r['size']}): " + ", ".join(r["head"]) + (f" and {more} more" if more > 0 else ""))
    return "\n".join(out) + "\n"


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Graph</title><style>
body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{padding:2px 10px;border-bottom:1px solid #ddd;text-align:left}}input{{margin:1em 0}}
</style></head><body><h1>Graph</h1><p>{stats}</p><input id="q" placeholder="filter paths"><label><input type="checkbox" id="h"> hubs only</label>
<table id="t"></table><div id="d"></div><script type="application/json" id="data">{data}</script><script>
const g=JSON.parse(document.getElementById("data").textContent),q=document.getElementById("q"),h=document.getElementById("h"),t=document.getElementById("t"),d=document.getElementById("d");
const near=n=>{{const s=new Map();for(const l of g.links){{if(l.source===n)s.set(l.target,l);if(l.target===n)s.set(l.source,l)}}return[...s].sort((a,b)=>g.nodes[b[0]].degree-g.nodes[a[0]].degree||a[0]-b[0]).slice(0,25)}};
const cell=(r,x,e)=>{{const c=document.createElement(e||"td");c.textContent=x;r.append(c)}};
const show=()=>{{t.replaceChildren();const r=t.insertRow();["path","format","degree","rank"].forEach(x=>cell(r,x,"th"));
g.nodes.forEach((n,i)=>{{if(n.path.includes(q.value)&&(!h.checked||n.is_hub)){{const r=t.insertRow();[n.path,n.format,n.degree,n.pagerank.toFixed(6)].forEach(x=>cell(r,x));
r.onclick=()=>{{d.textContent=n.path+": "+near(i).map(([j,l])=>g.nodes[j].path+" ("+l.type+")").join(", ")}}}}}})}};q.oninput=h.onchange=show;show();
</script></body></html>
"""


def page(documents: DataFrame, links: DataFrame, metrics: DataFrame) -> str:
    """A page with the graph inside it, for graphs that a browser can hold."""
    nodes = documents.select("path", "format").join(metrics, "path").orderBy("path").collect()
    at = {r["path"]: i for i, r in enumerate(nodes)}
    edges = sorted((at[r["source"]], at[r["target"]], r["type"], r["source_type"], r["weight"]) for r in view_links(links, documents).collect())
    data = {
        "nodes": [{"path": r["path"], "format": r["format"], "degree": r["degree"], "pagerank": r["pagerank"], "is_hub": r["is_hub"]} for r in nodes],
        "links": [dict(zip(("source", "target", "type", "source_type", "weight"), e)) for e in edges],
    }
    stats = html.escape(f"{len(nodes)} documents, {len(edges)} links")
    return _PAGE.format(stats=stats, data=json.dumps(data).replace("</", "<\\/"))
