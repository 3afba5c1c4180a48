"""Snapshots of a graph: versioned Parquet tables, merging, and one JSON document."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import EXTRACTED

SCHEMA_VERSION = 1
TABLES = ("documents", "entities", "links", "packages", "clusters", "metrics", "snapshot", "contents", "vectors")


def merge(old: DataFrame, fresh: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Fresh rows, and those old ones that have no fresh row and still exist."""
    kept = old.join(fresh.select(key), key, "left_anti").join(existing.select(key), key, "left_semi")
    return fresh.unionByName(kept, allowMissingColumns=True)


def write(tables: dict[str, DataFrame], root: str) -> str:
    """Write a version below ``root`` and point to it last, so that readers see whole versions only."""
    version = f"v-{uuid.uuid4().hex}"
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    pointer = spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").json(f"{root}/versions")
    return version


def latest(spark: SparkSession, root: str) -> str:
    row = spark.read.schema("version string, at timestamp").json(f"{root}/versions").orderBy(F.desc("at")).first()
    if row is None:
        raise FileNotFoundError(f"no snapshot below {root}")
    return row["version"]


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the last version written."""
    base = f"{root}/{latest(spark, root)}"
    out = {}
    for name in TABLES:
        try:
            out[name] = spark.read.parquet(f"{base}/{name}")
        except Exception as e:  # a version need not have every table
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def to_json(tables: dict[str, DataFrame], path: str) -> None:
    """One indented JSON document; for graphs that fit one file, since it is built on the driver."""
    rows = {name: [json.loads(r) for r in df.toJSON().collect()] for name, df in tables.items() if name not in ("snapshot", "contents", "vectors")}
    documents = {d["path"]: d | {"entities": []} for d in rows.get("documents", [])}
    for e in sorted(rows.get("entities", []), key=lambda e: (e["doc_path"], e["ordinal"])):
        documents[e["doc_path"]]["entities"].append({k: v for k, v in e.items() if k != "doc_path"})
    out = {"schema_version": SCHEMA_VERSION, "documents": documents} | {k: v for k, v in rows.items() if k not in ("documents", "entities")}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=4, sort_keys=True, ensure_ascii=False)


class SnapshotError(ValueError):
    """A JSON snapshot that has unknown keys or lacks what every graph has."""


def from_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a JSON document; unknown keys, missing documents or links are errors, another version is not."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    known = {"schema_version", "documents", *TABLES}
    if unknown := set(data) - known:
        raise SnapshotError(f"unknown keys: {sorted(unknown)}")
    if not data.get("documents"):
        raise SnapshotError("no documents")
    if "links" not in data:
        raise SnapshotError("no links")
    from graphloom import schema as S

    docs = [{k: v for k, v in d.items() if k != "entities"} for d in data["documents"].values()]
    entities = [e | {"doc_path": p} for p, d in data["documents"].items() for e in d.get("entities", [])]
    frame = lambda rows, schema: spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows])) if rows else spark.createDataFrame([], schema)
    out = {"documents": frame(docs, S.DOCUMENTS), "entities": frame(entities, S.ENTITIES), "links": frame(data["links"], S.LINKS)}
    out["links"] = out["links"].withColumn("source_type", F.coalesce(F.nullif("source_type", F.lit("")), F.lit(EXTRACTED)))
    return out
