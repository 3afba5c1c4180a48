"""Table schemas, vocabularies and constants of the document graph."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "map": T.MapType(T.StringType(), T.StringType()), "strings": T.ArrayType(T.StringType()),
}


def _table(text: str) -> T.StructType:
    """A schema from ``name kind`` pairs, which needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(","))])


FILES = _table("path string, language string, size bigint, updated_at timestamp, content string")
DOCUMENTS = _table("path string, format string, size bigint, updated_at timestamp, metadata map")
ENTITIES = _table("doc_path string, ordinal int, entity_id string, type string, name string, start_line int, end_line int, metadata map")
LINKS = _table("source_id string, target_id string, type string, weight double, source_type string, metadata map")
COMMITS = _table("hash string, author string, date timestamp, message string, files strings")

# Other tools read graphs with these names and weights.
EXTRACTED, INFERRED = "extracted", "inferred"
MIN_WEIGHT = 0.5
WEIGHT_SCALE = 10
MODULARITY_NODES = 2000
HUB_FRACTION, HUB_MIN_DEGREE = 0.05, 2
DAMPING, PAGERANK_ROUNDS, PAGERANK_TOLERANCE = 0.85, 100, 1e-9
COCHANGE_FILES = (2, 20)
COMMIT_LIMIT, COMMIT_FILES = 50, 50
DEFAULT_HOPS, DEFAULT_MIN_SCORE, MIN_TOP_K = 1, 0.65, 20
DIMENSIONS = 384
DOC_PAYLOAD_BYTES, ENTITY_PAYLOAD_BYTES = 256, 200
CHECK_TTL_SECONDS, REBUILD_DELAY_SECONDS = 2, 2
REPORT_TOP, REPORT_PREVIEW, LIST_PREVIEW = 25, 8, 3
REFERENCE_TARGETS = "class struct interface enum object protocol actor namespace module union typedef type".split()
SNIPPET_NOISE = "import package reference".split()
NOT_EMBEDDED = "import package link image-asset page property sequence-item container array object data-table variable export".split()
ALWAYS_SKIPPED = "import package".split()
CLUSTER_KINDS = "directory module network".split()
