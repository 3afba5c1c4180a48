"""Extraction of documents, entities and intra-file links from files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.extract import code, markup
from graphloom.operators.extract.model import Found
from graphloom.plans.shared import materialize

TEXT_FORMATS = {"markdown": markup.markdown, "json": markup.json_text, "yaml": markup.yaml, "toml": markup.toml, "dockerfile": markup.dockerfile, "make": markup.makefile}
_META = pa.map_(pa.string(), pa.string())
_ENTITY = pa.struct([("entity_id", pa.string()), ("type", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("metadata", _META)])
_LINK = pa.struct([("source_id", pa.string()), ("target_id", pa.string()), ("type", pa.string()), ("weight", pa.float64()), ("source_type", pa.string()), ("metadata", _META)])
_SCHEMA = (
    "path string, entities array<struct<entity_id:string,type:string,name:string,start_line:int,end_line:int,metadata:map<string,string>>>, "
    "links array<struct<source_id:string,target_id:string,type:string,weight:double,source_type:string,metadata:map<string,string>>>"
)


def extract_file(path: str, language: str, data: bytes | None) -> Found:
    """What one file holds; unknown formats and unreadable files hold nothing, and no content raises."""
    if data is None:
        return Found(path)
    try:
        if language == "pdf":
            return markup.pdf(path, data)
        if language == "spreadsheet":
            if path.lower().endswith((".csv", ".tsv")):
                return markup.csv_text(path, data.decode("utf-8", "replace"))
            return markup.xlsx(path, data) if path.lower().endswith(".xlsx") else Found(path)
        text = data.decode("utf-8", "replace")
        if language in TEXT_FORMATS:
            return TEXT_FORMATS[language](path, text)
        if language in code.LANGUAGES or language in ("python", "sql"):
            return code.scan(path, text, language)
    except RecursionError:
        pass
    return Found(path)


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``documents``, ``entities`` and ``links`` of files ``(path, language, size, updated_at, content binary)``.

    Contents pass through one Arrow map; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract_file(r["path"], r["language"], r["content"]) for r in batch.to_pylist()]
            pairs = lambda rows: [r | {"metadata": list(r["metadata"].items())} for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.path for f in found]), pa.array([pairs(f.entities) for f in found], pa.list_(_ENTITY)), pa.array([pairs(f.links) for f in found], pa.list_(_LINK))],
                ["path", "entities", "links"],
            )

    found = materialize(files.select("path", "language", F.col("content").cast("binary").alias("content")).mapInArrow(run, _SCHEMA), "extracted")
    documents = files.select("path", F.col("language").alias("format"), "size", "updated_at", F.create_map(F.lit("processor"), F.col("language")).alias("metadata"))
    entities = found.select(F.col("path").alias("doc_path"), F.posexplode("entities").alias("ordinal", "e")).select("doc_path", "ordinal", "e.*")
    links = found.select(F.explode("links").alias("l")).select("l.*")
    return documents, entities, links


def register(spark) -> None:
    """``extract_entities(path, format, content)`` as a table function for SQL."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="entity_id string, type string, name string, start_line int, end_line int")
    class ExtractEntities:
        def eval(self, path: str, language: str, content: str):
            for e in extract_file(path, language, content.encode() if content is not None else None).entities:
                yield e["entity_id"], e["type"], e["name"], e["start_line"], e["end_line"]

    spark.udtf.register("extract_entities", ExtractEntities)
