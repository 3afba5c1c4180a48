"""PageRank and hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.shared import materialize, release
from graphloom.schema import DAMPING, HUB_FRACTION, HUB_MIN_DEGREE, PAGERANK_ROUNDS, PAGERANK_TOLERANCE

#: Rounds between cuts of the lineage.
CUT_EVERY = 4
#: Rows that a top-k holds in a task, and bins by which a larger one is cut.
TOP_ROWS, BINS = 10_000, 4096


def pagerank(edges: DataFrame, rounds: int = PAGERANK_ROUNDS, tolerance: float | None = PAGERANK_TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """``(node, rank)`` of weighted undirected edges ``(a, b, w)`` given in both directions.

    Every node has an edge, so no rank leaks.  Edges with their shares are written once,
    partitioned by their source; a round is one join and one aggregate combined on the map
    side.  With a tolerance, rounds end when the ranks' summed change falls below it, which
    is looked at when the lineage is cut.
    """
    # Sums are combined on the map side, so that a hub's edges are not gathered for it.
    total = edges.groupBy("a").agg(F.sum("w").alias("total"))
    shares = materialize(edges.join(total, "a").select("a", "b", (F.col("w") / F.col("total")).alias("share")), "shares")
    nodes = materialize(shares.select(F.col("a").alias("node")).distinct(), "nodes")
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = cut = materialize(nodes.withColumn("rank", F.lit(1.0 / n)), "ranks")
    for i in range(1, rounds + 1):
        sent = shares.join(ranks, shares.a == ranks.node).groupBy("b").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        ranks = sent.select(F.col("b").alias("node"), (F.lit((1 - damping) / n) + damping * F.col("got")).alias("rank"))
        if i % CUT_EVERY == 0 or i == rounds:
            ranks = materialize(ranks, "ranks")
            if tolerance is not None and i < rounds:
                change = ranks.join(cut.withColumnRenamed("rank", "was"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
                if change < tolerance:
                    release(cut)
                    return ranks
            release(cut)
            cut = ranks
    return ranks


def hubs(metrics: DataFrame) -> DataFrame:
    """``metrics`` (path, degree, weighted_degree, pagerank) with ``is_hub``.

    Of the documents with two neighbours or more, the first twentieth of all documents,
    rounded up, by degree and rank over their maxima.  The cut is the least score of the
    top rows, found without sorting everything.
    """
    top = metrics.agg(F.max("degree").alias("max_degree"), F.max("pagerank").alias("max_rank"), F.count("*").alias("n"))
    scored = metrics.join(F.broadcast(top), F.lit(True)).withColumn(
        "score",
        F.when(F.col("max_degree") > 0, F.col("degree") / F.col("max_degree")).otherwise(0.0)
        + F.when(F.col("max_rank") > 0, F.col("pagerank") / F.col("max_rank")).otherwise(0.0),
    )
    n = metrics.count()
    count = -(-n * int(HUB_FRACTION * 100) // 100)
    scored = scored.where(F.col("degree") >= HUB_MIN_DEGREE).select("path", F.round("score", 9).alias("score"))
    best = first_k(materialize(scored, "scores"), "score", count, "path").select("path", F.lit(True).alias("hub"))
    return metrics.join(best, "path", "left").withColumn("is_hub", F.coalesce("hub", F.lit(False))).drop("hub")


def first_k(rows: DataFrame, score: str, k: int, tie: str, low: float = -2.0, high: float = 2.0) -> DataFrame:
    """The ``k`` rows of the greatest scores, ties by ``tie``, for a ``k`` that grows with the data.

    A top-k keeps k rows in every task.  Beyond ``TOP_ROWS`` the cut is found by counts of
    rows in ``BINS`` bins of the score, and in as many of the bin of the cut; only rows of
    that small bin are ordered.
    """
    order = [F.desc(score), F.col(tie)]
    if k <= TOP_ROWS:
        return rows.orderBy(*order).limit(k)
    at = (F.col(score) - low) * (BINS / (high - low))
    coarse, left = F.floor(at), k
    above = F.lit(False)
    part = rows
    for level in (coarse, F.floor((at - coarse) * BINS)):
        counts = {r["bin"]: r["n"] for r in part.groupBy(level.alias("bin")).agg(F.count("*").alias("n")).collect()}
        cut = None
        for b in sorted(counts, reverse=True):
            if counts[b] >= left:
                cut = b
                break
            left -= counts[b]
        if cut is None:
            return rows
        inside = F.lit(True) if part is rows else coarse == first
        above = above | (inside & (level > cut))
        part = part.where(level == cut)
        first = cut
    return rows.where(above).unionByName(part.orderBy(*order).limit(left))


def ranked(metrics: DataFrame, limit: int | None = None) -> DataFrame:
    """Hubs first, then by rank and path."""
    out = metrics.orderBy(F.desc("is_hub"), F.round("pagerank", 9).desc(), "path")
    return out.limit(limit) if limit else out
