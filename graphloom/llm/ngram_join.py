"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

Sets of distinct five-word shingles are linked when they share at least 80 % of their
union.  The join is exact:

* *Size bands.*  Linked sets differ in size by a quarter at most, so a set is compared in
  its own band of sizes and, if it may have a larger partner there, in the next.
* *Tiles.*  Two linked sets of sizes a and b differ in at most (a + b) / 9 shingles.  A band
  cuts the range of hashes into parts, more than that many of which are not empty; linked
  sets then have an identical part among their first (a + b) / 9 + 1 in an order that all
  sets follow (fullest parts first, then by hash).  The content of a part is the key of a
  tile, and a passage that very many documents share does not fill a part by itself.  A set
  that leaves too many parts empty has its least shingles as keys besides: if both sets of
  a linked pair are such, these have one in common.
* *Bitmaps.*  A set's signature has the parity of the number of its shingles that fall on
  each bit.  Bits that differ count shingles that differ, so the number of set bits in the
  exclusive or bounds the overlap from above.
* *Intersection.*  Pairs that pass are read again as whole texts and their sorted sets are
  intersected.

``_linkage`` says how tiles are worked off without pairing whole groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _linkage, _tokens
from graphloom.plans.shared import arrow_rows, materialize, reclaim, release, tracked

WIDTH = 5
PERCENT = 80
#: Ratio of the levels of sizes; 1.25 is less than two of them.
RATIO = 1.12
#: Keys of so many sets give all their pairs at once; whole texts are dear to verify.
PAIRED = 3


def _edges(limit: int = 1 << 40) -> np.ndarray:
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, -(-out[-1] * 3 // 2)))
    return np.array(out)


_BANDS = _edges()


def _most_apart(n: int, high: int, percent: int) -> int:
    """Most shingles by which a set of n and a partner of fewer than ``high`` can differ."""
    partner = min(n * 100 // percent, high - 1)
    return max((n + b) * (100 - percent) // (100 + percent) for b in (partner, n))


def tile_keys(items: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a sorted set: in its own band, and in the next if a partner may be there."""
    n = len(items)
    if not n:
        return items
    own = int(np.searchsorted(_BANDS, n, side="right")) - 1
    out = []
    for band in (own, own + 1):
        low, high = int(_BANDS[band]), int(_BANDS[band + 1])
        if band > own and n * 100 // percent < low:
            break
        apart = _most_apart(n, high, percent)
        salt = np.uint64(band * 0x51_7C_C1 + 1)
        if high <= 96:
            keys = _tokens.mix(items + salt)
        else:
            parts = high * (100 if high <= 300 else 80) * (100 - percent) // (20 * 200)
            part = ((items >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            count = np.diff(np.append(begin, n))
            keys = np.add.reduceat(_tokens.mix(items + salt), begin)
            keys = _tokens.mix(keys + part[begin] * np.uint64(0xA24BAED4963EE407))
            # Fullest first: the order is part of the key.
            keys = (np.uint64(63) - np.minimum(count, 63).astype(np.uint64) << np.uint64(58)) | (keys >> np.uint64(6))
            if len(keys) <= apart:
                out.append(np.partition(_tokens.mix(items + salt * np.uint64(3)), min(apart, n - 1))[: apart + 1])
        if len(keys) > apart + 1:
            keys = np.partition(keys, apart)[: apart + 1]
        out.append(keys)
    # Spread over all buckets again.
    return _tokens.mix(np.concatenate(out))


def bitmap(items: np.ndarray) -> bytes:
    """Parity bitmap of 1024 bits, or of 8192 for sets of over 1200."""
    width = 1024 if len(items) <= 1200 else 8192
    bits = np.bincount((items & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _fold(mark: bytes) -> np.ndarray:
    words = np.frombuffer(mark, dtype="<u8")
    return words if len(words) == 16 else np.bitwise_xor.reduce(words.reshape(-1, 16), axis=0)


def _may_link(percent: int):
    """Whether sizes and signatures leave a pair the overlap that it needs."""

    def keep(size: np.ndarray, mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        at = np.flatnonzero(ok)
        if len(at):
            small = np.stack([_fold(m) for m in mark])
            for part in np.array_split(at, max(1, len(at) >> 15)):
                x, y = a[part], b[part]
                apart = np.bitwise_count(small[x] ^ small[y]).sum(axis=1, dtype=np.int64)
                total = size[x] + size[y]
                ok[part] = apart * (100 + percent) <= total * (100 - percent)
        wide = [i for i in np.flatnonzero(ok) if len(mark[a[i]]) == len(mark[b[i]]) > 128]
        for i in wide:
            x, y = (np.frombuffer(mark[j[i]], dtype="<u8") for j in (a, b))
            ok[i] = int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (size[a[i]] + size[b[i]]) * (100 - percent)
        return ok

    return keep


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _text_key():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def jaccard_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, text_key, n_shingles, class)``: the class of linked sets of each row, null without words."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key(), "text")

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator:
        for batch in batches:
            ids, sizes, marks, seen, none = [], [], [], set(), pa.nulls(batch.num_rows, pa.int32())
            for s in _tokens.shingle_sets(_texts(batch), width):
                ids.append(_tokens.set_id(s))
                sizes.append(len(s))
                marks.append(bitmap(s) if len(s) and ids[-1] not in seen else None)
                if marks[-1]:
                    seen.add(ids[-1])
                    keys = tile_keys(s, percent)
                    yield _linkage.entries(keys, np.full(len(keys), ids[-1]), np.full(len(keys), _linkage.levels(np.array([len(s)]), RATIO, 1)[0]))
            columns = [pa.array(ids, pa.int64()), batch.column("doc_id"), batch.column("text_key"), none, pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_linkage.NODES)

    rows = _linkage.keyed(docs, keys_of, paired=PAIRED)
    table = rows.where(F.col("kind") == _linkage.NODE).select(F.col("x").alias("id"), "doc_id", "text_key", "size", "mark")
    nodes = table.where("mark is not null").groupBy("id").agg(F.first("size").alias("size"), F.first("mark").alias("mark"), F.min(_linkage.place()).alias("place"))
    nodes = materialize(nodes, "sets")
    keep = _may_link(percent)
    contents = _linkage.Contents(docs, nodes, lambda rows: rows.select(F.explode("ids").alias("id"), "text"))
    within = f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
    comps = _linkage.components(rows, nodes, lambda pairs, later: _linked(_linkage.signed(pairs, nodes, within, keep), contents, later, width, percent), keep)
    release(nodes, *contents.tables)
    light = table.select("doc_id", "text_key", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("id")).alias("id"))
    return light.join(_linkage.small(comps), light.id == comps.node, "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component", "id").alias("class"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text).

    Returns one row for each row of ``docs``: ``doc_id, n_shingles, component_id``, the
    smallest doc_id reachable by links.  Null and empty texts, and texts of white space,
    have no shingles and no links; copies of a text are linked if it has words.  A null
    doc_id is never the smallest unless its class has no other; an isolated row's
    component is its own doc_id.  Other columns of ``docs`` are not read.
    """
    classes = jaccard_classes(docs, width, percent)
    least = materialize(classes.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "least")
    named = classes.join(_linkage.small(least.select("class", "least")), "class", "left")
    # A class of one row is its own.
    return named.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, the one of the smallest doc_id, null last.

    Rows without words all stay.  Rows are packed while names are added, so columns may have
    any name.
    """
    with tracked() as made:
        classes = jaccard_classes(docs, width, percent).where("class is not null")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
        shared = materialize(classes.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), "shared")
        classes = classes.join(_linkage.small(shared), "class")
        first = materialize(classes.groupBy("class").agg(F.min(place).alias("first")), "first")
        rest = materialize(classes.join(_linkage.small(first), "class").where(place != F.col("first")).select("doc_id", "text_key").distinct(), "copies")
        repeated = materialize(classes.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key"), "repeated")
    release(*(t for t in made if t is not rest and t is not repeated))
    reclaim(docs.sparkSession)
    given = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), _text_key())
    out = given.join(_linkage.small(rest), (given["text_key"] == rest["text_key"]) & given["doc_id"].eqNullSafe(rest["doc_id"]), "left_anti")
    # Of repeated rows, equal in doc_id and text, all are left: one of them stays.
    if not repeated.isEmpty():
        again = _linkage.small(repeated)
        both = (out["text_key"] == repeated["text_key"]) & out["doc_id"].eqNullSafe(repeated["doc_id"])
        out = out.join(again, both, "left_anti").unionByName(out.join(again, both, "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _linked(pairs: DataFrame, contents: _linkage.Contents, later: DataFrame | None, width: int, percent: int) -> DataFrame:
    """The pairs whose whole texts are linked."""
    left = materialize(pairs, "survivors")
    ids = left.select(F.explode(F.array("a", "b")).alias("id"))
    contents.read((ids if later is None else ids.unionAll(later)).distinct())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] = (-1, np.empty(0, dtype=np.uint64))
        for batch in batches:
            ids, ta = batch.column("a").to_pylist(), batch.column("text_a")
            ok = []
            for i, b in enumerate(_tokens.shingle_sets(_texts(batch, "text_b"), width)):
                if ids[i] != held[0] or i == 0:
                    held = (ids[i], next(_tokens.shingle_sets([(ta[i].as_py() or "").encode()], width)))
                a = held[1]
                both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # Two whole texts a row.
    with arrow_rows(left.sparkSession, _linkage.ARROW_ROWS // 4):
        linked = materialize(contents.beside(left).mapInArrow(_tokens.tidy(exact), "a long, b long"), "linked")
    release(left)
    return linked
