"""Groups of documents: by directory, by package and by coupling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators.components import connected_components
from graphloom.plans.shared import materialize
from graphloom.schema import MODULARITY_NODES


def common_root(documents: DataFrame) -> DataFrame:
    """One row, ``root``: the longest directory prefix of all documents, from the least and greatest."""
    dirs = documents.select(F.split(paths.dir_name(F.col("path")), "/").alias("s")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return dirs.select(F.coalesce(paths.common_prefix(F.col("lo"), F.col("hi")), F.lit("")).alias("root"))


def directory_members(documents: DataFrame) -> DataFrame:
    """``(kind, name, path)``: each document in its directory below the common root, ``.`` for the root."""
    at = documents.select("path", paths.dir_name(F.col("path")).alias("dir")).join(F.broadcast(common_root(documents)), F.lit(True))
    name = F.when(F.col("dir") == F.col("root"), F.lit(".")).otherwise(paths.relative(F.col("dir"), F.col("root")))
    return at.select(F.lit("directory").alias("kind"), name.alias("name"), "path")


def module_members(members: DataFrame) -> DataFrame:
    """``(kind, name, path)`` from ``(path, pkg_key)``."""
    return members.select(F.lit("module").alias("kind"), F.col("pkg_key").alias("name"), "path")


def clusters(members: DataFrame) -> DataFrame:
    """``(cluster_id, name, kind, members, size)`` from ``(kind, name, path)``."""
    return members.groupBy("kind", "name").agg(F.sort_array(F.collect_list("path")).alias("members"), F.count("*").alias("size")).select(
        paths.cluster_id(F.col("kind"), F.col("name")).alias("cluster_id"), "name", "kind", "members", "size"
    )


def greedy_modularity(edges: list[tuple[str, str, int]], total: int) -> dict[str, str]:
    """Communities of one component: the best pair of communities merges while that gains.

    edges: both directions, weights in tenths.  total: half the summed weight of the whole
    graph.  The weight between two communities counts both directions, which favours
    merging.  Ties go to the communities of the least first members; a community is named
    by its least member.
    """
    nodes = sorted({a for a, _, _ in edges})
    place = {x: i for i, x in enumerate(nodes)}
    degree = [0] * len(nodes)
    inter: list[dict[int, int]] = [{} for _ in nodes]
    for a, b, w in edges:
        i, j = place[a], place[b]
        degree[i] += w
        for x, y in ((i, j), (j, i)):
            inter[x][y] = inter[x].get(y, 0) + w
    group = list(range(len(nodes)))
    alive = set(group)
    while True:
        best = None
        for i in sorted(alive):
            for j, w in inter[i].items():
                if j > i:
                    gain = 2 * total * w - degree[i] * degree[j]
                    if gain > 0 and (best is None or (-gain, i, j) < best):
                        best = (-gain, i, j)
        if best is None:
            break
        _, i, j = best
        alive.discard(j)
        degree[i] += degree[j]
        for k, w in inter[j].items():
            del inter[k][j]
            if k != i:
                inter[i][k] = inter[i].get(k, 0) + w
                inter[k][i] = inter[k].get(i, 0) + w
        inter[j] = {}
        group = [i if g == j else g for g in group]
    return {x: nodes[group[place[x]]] for x in nodes}


def communities(edges: DataFrame, cap: int = MODULARITY_NODES) -> DataFrame:
    """``(path, community)`` of a coupling graph: greedy modularity, or components where it is larger than ``cap``.

    Merges never cross components, so each component is worked off by itself; it has at
    most ``cap`` nodes.
    """
    edges = materialize(edges.select("a", "b", "w"), "coupling")
    state = edges.agg(F.countDistinct("a").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    comps = connected_components(edges)
    if state["n"] > cap:
        return comps.select(F.col("node").alias("path"), F.col("component").alias("community"))
    total = int(state["w"]) // 2

    def one(part: pd.DataFrame) -> pd.DataFrame:
        found = greedy_modularity(sorted(zip(part["a"], part["b"], map(int, part["w"]))), total)
        return pd.DataFrame({"path": list(found), "community": list(found.values())})

    placed = edges.join(comps, edges.a == comps.node)
    return placed.select("component", "a", "b", "w").groupBy("component").applyInPandas(one, "path string, community string")


def network_members(groups: DataFrame) -> DataFrame:
    """``(kind, name, path)`` from ``(path, community)``; single documents form no cluster.

    A cluster is named by the directory that most members share, of those the longest,
    then the least, if two share one; else by the common directory; else by its community.
    Equal names are numbered in the order of their communities.
    """
    at = groups.withColumn("dir", paths.dir_name(F.col("path"))).withColumn("size", F.count("*").over(Window.partitionBy("community"))).where("size > 1")
    modal = at.groupBy("community", "dir").agg(F.count("*").alias("n")).where("n > 1 and dir <> '.'")
    modal = modal.groupBy("community").agg(F.min_by("dir", F.struct(-F.col("n"), -F.char_length("dir"), "dir")).alias("modal"))
    shared = at.groupBy("community").agg(F.min(F.split("dir", "/")).alias("lo"), F.max(F.split("dir", "/")).alias("hi"))
    shared = shared.select("community", F.nullif(paths.common_prefix(F.col("lo"), F.col("hi")), F.lit("")).alias("shared"))
    named = shared.join(modal, "community", "left").select("community", F.coalesce("modal", F.when(F.col("shared") != ".", F.col("shared")), "community").alias("base"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("community"))
    named = named.withColumn("nth", nth).select("community", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" #"), F.col("nth").cast("string"))).alias("name"))
    return at.join(named, "community").select(F.lit("network").alias("kind"), "name", "path")
