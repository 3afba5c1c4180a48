"""Narrowed context: what lies near an entry and is close to a query, within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.paths import owner
from graphloom.operators import traverse, vectors
from graphloom.plans.shared import materialize
from graphloom.schema import DEFAULT_HOPS, DEFAULT_MIN_SCORE, MIN_TOP_K, SNIPPET_NOISE


def selected(
    documents: DataFrame, links: DataFrame, node_vectors: DataFrame, entry: str, query: list[float], hops: int = DEFAULT_HOPS, min_score: float = DEFAULT_MIN_SCORE,
    source_type: str | None = None, exclude: list[str] | None = None, package_files: DataFrame | None = None,
) -> DataFrame:
    """``(path, hop, score, is_entry)``: reachable documents that are near the query, entries always."""
    start = traverse.entry_documents(documents, entry)
    frontier = materialize(traverse.reachable(start, links, documents, hops, source_type, exclude, package_files), "frontier")
    k = max(2 * frontier.count(), MIN_TOP_K)
    near = vectors.top_k(node_vectors, query, k, min_score if min_score > 0 else DEFAULT_MIN_SCORE)
    best = near.groupBy(owner(F.col("node_id")).alias("path")).agg(F.max("score").alias("score"))
    out = frontier.join(best, "path", "left").withColumn("is_entry", F.col("hop") == 0).where("score is not null or is_entry")
    return out.orderBy(F.desc("is_entry"), F.coalesce("score", F.lit(0.0)).desc(), "path")


def snippets(entities: DataFrame, contents: DataFrame, scores: DataFrame) -> DataFrame:
    """``(path, nth, snippet)``: code of each document's entities, best score first, equal ranges once."""
    own = entities.where(~F.col("type").isin(*SNIPPET_NOISE) & (F.col("start_line") > 0))
    own = own.withColumn("end_line", F.greatest("start_line", F.coalesce("end_line", F.col("start_line"))))
    once = own.withColumn("first", F.row_number().over(Window.partitionBy("doc_path", "start_line", "end_line").orderBy("ordinal"))).where("first = 1")
    scored = once.join(scores.select(F.col("node_id").alias("entity_id"), "score"), "entity_id", "left")
    nth = F.row_number().over(Window.partitionBy("doc_path").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "ordinal"))
    cut = scored.withColumn("nth", nth).join(contents.select(F.col("path").alias("doc_path"), "content"), "doc_path", "left")
    missing = F.concat(F.lit("[Error: cannot read "), F.col("doc_path"), F.lit("]"))
    return cut.select(F.col("doc_path").alias("path"), "nth", F.coalesce(X.line_slice(F.col("content"), F.col("start_line"), F.col("end_line")), missing).alias("snippet"))


def within_budget(blocks: DataFrame, max_tokens: int, order: list, column: str = "snippet") -> DataFrame:
    """Blocks until the budget is used: the first that does not fit is cut, later ones go. 0 is no budget.

    The blocks are one answer's, so their order is one task's.
    """
    if max_tokens <= 0:
        return blocks.withColumn("tokens", X.tokens(F.col(column)))
    before = F.coalesce(F.sum("tokens").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = blocks.withColumn("tokens", X.tokens(F.col(column))).withColumn("before", before).where(F.col("before") < max_tokens)
    left = F.lit(max_tokens) - F.col("before")
    cut = F.when(F.col("tokens") > left, X.truncate_chars(F.col(column), left * 4)).otherwise(F.col(column))
    return run.withColumn(column, cut).withColumn("tokens", F.least("tokens", left)).drop("before")


def files_within_budget(files: DataFrame, max_tokens: int, order: list, column: str = "content") -> DataFrame:
    """Files up to and including the one that reaches the budget, with ``truncated`` where more would follow."""
    window = Window.orderBy(*order)
    run = files.withColumn("tokens", X.tokens(F.col(column)))
    before = F.coalesce(F.sum("tokens").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = run.withColumn("before", before).withColumn("follows", F.lead(F.lit(True)).over(window).isNotNull())
    kept = run.where((F.col("before") < max_tokens) | F.lit(max_tokens <= 0))
    last = F.col("follows") & (F.col("before") + F.col("tokens") >= max_tokens) & F.lit(max_tokens > 0)
    return kept.withColumn("truncated", last).drop("before", "follows")
