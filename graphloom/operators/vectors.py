"""Vectors of nodes: payloads, embedding, similarity and incremental upkeep."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators.rank import first_k
from graphloom.schema import ALWAYS_SKIPPED, DOC_PAYLOAD_BYTES, ENTITY_PAYLOAD_BYTES, NOT_EMBEDDED


def document_payloads(documents: DataFrame, contents: DataFrame) -> DataFrame:
    """``(node_id, payload, payload_hash)``: path, format and the first bytes of the content."""
    joined = documents.join(contents.select("path", "content"), "path", "left")
    head = F.concat(F.lit("File: "), F.col("path"), F.lit(". Language: "), F.col("format"), F.lit("."))
    body = F.when(F.col("content").isNull(), head).otherwise(F.concat(head, F.lit("\n"), X.truncate_bytes(F.col("content"), DOC_PAYLOAD_BYTES)))
    return joined.select(F.col("path").alias("node_id"), body.alias("payload")).withColumn("payload_hash", X.payload_hash(F.col("payload")))


def entity_payloads(entities: DataFrame, contents: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """``(node_id, payload, payload_hash)`` of the entities that are embedded: kind, name, place and a snippet."""
    skip = sorted({*ALWAYS_SKIPPED, *(NOT_EMBEDDED if skip is None else skip)})
    kept = entities.where(~F.col("type").isin(*skip)).join(contents.select(F.col("path").alias("doc_path"), "content"), "doc_path", "left")
    head = F.concat(F.lit("Type: "), F.col("type"), F.lit(", Name: "), F.col("name"), F.lit(". Defined in "), F.col("doc_path"), F.lit("."))
    snippet = X.truncate_bytes(X.line_slice(F.col("content"), F.col("start_line"), F.col("end_line")), ENTITY_PAYLOAD_BYTES)
    body = F.when(F.col("start_line") > 0, F.concat_ws("\n", head, F.nullif(snippet, F.lit("")))).otherwise(head)
    return kept.select(F.col("entity_id").alias("node_id"), body.alias("payload")).withColumn("payload_hash", X.payload_hash(F.col("payload")))


def hashing_embedder(dimensions: int = 384) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder without a model: signed counts of hashed words, of unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for row, t in zip(out, texts):
            for word in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dimensions] += 1.0 if h >> 63 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed


def embed(payloads: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """``(node_id, embedding, payload_hash)``; the embedder gets one Arrow batch at a time."""
    embedder = embedder or hashing_embedder()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"node_id": part["node_id"], "embedding": list(embedder(list(part["payload"]))), "payload_hash": part["payload_hash"]})

    return payloads.select("node_id", "payload", "payload_hash").mapInPandas(run, "node_id string, embedding array<float>, payload_hash string")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def top_k(vectors: DataFrame, query: list[float], k: int, min_score: float | None = None, id_column: str = "node_id") -> DataFrame:
    """The ``k`` nearest vectors to ``query`` and their scores, best first, ties by id."""
    at = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(id_column, F.round(cosine(F.col("embedding"), at), 6).alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return first_k(scored, "score", k, id_column)


def check_dimensions(vectors: DataFrame, dimensions: int) -> DataFrame:
    """``vectors``, failing where one has another length."""
    wrong = F.concat(F.lit(f"expected {dimensions} dimensions, found "), F.size("embedding").cast("string"))
    return vectors.withColumn("embedding", F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(F.raise_error(wrong)))


def dirty(payloads: DataFrame, vectors: DataFrame) -> DataFrame:
    """Payloads without a vector of the same id and hash."""
    return payloads.join(vectors.select("node_id", "payload_hash"), ["node_id", "payload_hash"], "left_anti")


def upkeep(vectors: DataFrame, payloads: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """Vectors for ``payloads``: unchanged ones kept, others made anew, those of ids that are gone dropped."""
    kept = vectors.join(payloads.select("node_id", "payload_hash").distinct(), ["node_id", "payload_hash"], "left_semi")
    return kept.select("node_id", "embedding", "payload_hash").unionByName(embed(dirty(payloads, vectors), embedder))


def upkeep_counts(vectors: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row: ``reused, embedded, pruned``."""
    both = payloads.select("node_id", F.col("payload_hash").alias("new")).join(vectors.select("node_id", F.col("payload_hash").alias("old")), "node_id", "full")
    is_new, is_old = F.col("new").isNotNull(), F.col("old").isNotNull()
    return both.agg(
        F.count_if(is_new & is_old & (F.col("new") == F.col("old"))).alias("reused"),
        F.count_if(is_new & (~is_old | (F.col("new") != F.col("old")))).alias("embedded"),
        F.count_if(~is_new & is_old).alias("pruned"),
    )
