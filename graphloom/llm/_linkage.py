"""Finding every linked pair of items that share a key, without pairing whole groups.

Items are identified by the hash of their content, so exact copies are one item.  Each
item has some keys, chosen so that two linked items share one, and a level of its size;
linked items are at most ``REACH`` levels apart.  Keys may be marked as ``HALF``: linked items
that share no other keys then share two of these at least.  Then

1. every task sorts the keys of its block of items and passes them on, packed by bucket of
   the key.  Of a key with more than ``LOCAL`` items in the block only the first goes on:
   however many items share a key, a task that gathers a bucket gets a few entries for each
   block.  The others are members of a large key;
2. the gathering task works off one bucket after the other.  A key of up to ``PAIRED`` items
   gives all its pairs whose levels are near and is done, unless these are more than
   ``dense`` times the items, as of many copies with few changes.  Of such or a larger key, each item is
   paired with the first of its level, and all are members.  All distinct pairs but those
   that a single ``HALF`` key has given are verified, and the components of the verified
   links are found;
3. only large keys whose items still lie in several components are looked at again: their
   items are dealt into tiles of bounded size, of which none has two items of the key's
   largest component that must meet.  Of the pairs across components that pass a bound from
   the items' signatures, only as many as would join their components are verified first, in
   ``FORESTS`` rounds of different order, and then all that are left.

Linked items end in one component: they share a key, or two, and either one of them is
large, and they are in one component or meet in the last round of step 3, or none is, and
their pair was given by each in step 2.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _tokens
from graphloom.operators.components import connected_components, joined_components
from graphloom.plans.shared import arrow_rows, materialize, reclaim, release, relieve

#: A tag has the level of an item's size and, in its last bit, whether the entry only probes: two probes make no pair.
#: Above these 8 bits it may have the key's place in the item, counted from 1, and above these 24 what follows the place, in steps.
ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("tag", "<u4")])
#: Bit of a key, the last but one that is sent, that only counts half; turns go by the last.
HALF = np.uint64(1 << 17)
#: Bytes of a packed entry.
WIDTH = 18
PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
PAIRS, KEY, HEAD, MEMBER, NODE, LATER = range(6)
#: Levels by which linked items differ at most.
REACH, LEVELS = 2, 127
#: Places that a tag can have; and by how much places in linked items differ at most, by the higher level (``levels`` of 1.045 and 20).
PLACES = 0xFFFF
SHIFT = np.append(np.ceil(1.045 ** np.arange(1, LEVELS + 1)), PLACES).astype(np.int64)
#: Steps by level in which a tag counts what follows a place, and the bits of a tag without that.
FOLLOWS = -(-SHIFT // 4)
PLACED = 0xFFFFFF
#: Levels that a part of a large key has; it meets its neighbours only.
BAND = REACH + 1
#: Parts by place that an item can lie in: it is no longer than 20 times ``SHIFT`` of its level, up to the last one.
PARTS = 21
#: Key entries that a task sorts at once.
BLOCK = 1 << 19
#: Most items of a key that a block passes on, and with which a gathered key is paired in whole.
LOCAL, PAIRED = 8, 128
#: A gathered key is paired in whole only if that gives no more pairs than so many times its items; none has more than ``PAIRED``.
DENSE = PAIRED
#: Index pairs that are looked at together.
STEP = 1 << 18
#: Rows of an Arrow batch.
ARROW_ROWS = 2048
#: Items on each edge of a tile.
TILE = 512
#: Rounds in which tiles give forests of pairs.
FORESTS = 2
#: Rows whose copy to every executor is proven small.
BROADCAST_ROWS = 1 << 19
PACKED = "kind int, bucket int, payload binary"
ROWS = "kind int, x long, y long, tag int, doc_id long, text_key long, line int, size long, mark binary"
_OF_NODES = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int32()), ("size", pa.int64()), ("mark", pa.binary())]
NODES = pa.schema([("x", pa.int64()), *_OF_NODES])
_ROWS = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("tag", pa.int32()), *_OF_NODES])


def small(frame: DataFrame) -> DataFrame:
    """``frame`` to be broadcast if it has few rows; counted first."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def levels(size: np.ndarray, ratio: float, base: int) -> np.ndarray:
    """Levels of sizes, each ``ratio`` times the one before it."""
    return np.clip(np.log(np.maximum(size, 1) / base) / np.log(ratio), 0, LEVELS).astype(np.uint8)


def entries(key: np.ndarray, item: np.ndarray, level: np.ndarray, probe: bool = False, place: np.ndarray | int = 0, half: bool = False, follows: np.ndarray | None = None) -> np.ndarray:
    """place: from 1, where a linked item has the key within ``SHIFT``, or 0.  follows: how much of the item follows the key; linked items differ in both together by ``SHIFT`` at most.  half: linked items share two such keys."""
    out = np.empty(len(key), dtype=ENTRY)
    # Sixteen bits less are sent; a key in common says little by itself.
    out["key"], out["id"], out["tag"] = key & ~(HALF | np.uint64(0xFFFF)) | (HALF if half else np.uint64(0)), item, level.astype(np.uint32) * 2 + probe + np.uint32(256) * np.asarray(place, dtype=np.uint32)
    if follows is not None:
        steps = 1 + follows // FOLLOWS[level]
        out["tag"] |= np.where((steps > 255) | (np.asarray(place) == 0), 0, steps).astype(np.uint32) << np.uint32(24)
    return out


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether tags may belong to a linked pair."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    a, b, p, q = (x & 255) >> 1, (y & 255) >> 1, x >> 8 & PLACES, y >> 8 & PLACES
    ok = (np.abs(a - b) <= REACH) & ((x & y & 1) == 0)
    some = np.nonzero(ok & (p != 0) & (q != 0))
    a, b, p, q, x, y = a[some], b[some], p[some], q[some], x[some] >> 24 & 255, y[some] >> 24 & 255
    # What follows is between x and x + u, and y and y + v.
    u, v = FOLLOWS[a] - 1, FOLLOWS[b] - 1
    apart = np.where((x == 0) | (y == 0), 0, np.maximum(np.maximum((x - 1) * (u + 1) - (y - 1) * (v + 1) - v, (y - 1) * (v + 1) - (x - 1) * (u + 1) - u), 0))
    ok[some] = np.abs(p - q) + apart <= SHIFT[np.maximum(a, b)]
    return ok


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), dtype=PAIR)
    out["a"], out["b"] = np.minimum(a, b), np.maximum(a, b)
    return out[out["a"] != out["b"]]


def _summed(pairs: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their weights."""
    order = np.lexsort((pairs["b"], pairs["a"]))
    pairs = pairs[order]
    fresh = np.ones(len(pairs), dtype=bool)
    fresh[1:] = (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])
    begin = np.flatnonzero(fresh)
    return pairs[begin], np.add.reduceat(weight[order], begin) if len(begin) else weight


def _unique(pairs: np.ndarray) -> np.ndarray:
    order = np.lexsort((pairs["b"], pairs["a"]))
    pairs = pairs[order]
    fresh = np.ones(len(pairs), dtype=bool)
    fresh[1:] = (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])
    return pairs[fresh]


class Groups:
    """Distinct entries in the order of key, tag and item; ``key, id, tag, flag``, and where groups begin."""

    def __init__(self, key: np.ndarray, item: np.ndarray, tag: np.ndarray, flag: np.ndarray | None = None):
        order = np.argsort(key)
        sorted_key = key[order]
        differs = sorted_key[1:] != sorted_key[:-1]
        alone = np.concatenate(([True], differs)) & np.concatenate((differs, [True])) if len(key) else np.empty(0, dtype=bool)
        if flag is not None:
            alone &= ~flag[order]
        self.alone = order[alone]
        at = order[~alone]
        key, item, tag = key[at], item[at], tag[at]
        flag = np.zeros(len(at), dtype=bool) if flag is None else flag[at]
        order = np.lexsort((~flag, tag, item, tag & PLACED, key))
        key, item, tag, flag = key[order], item[order], tag[order], flag[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1]) | (tag[1:] != tag[:-1])
        self.key, self.id, self.tag, self.flag = key[fresh], item[fresh], tag[fresh], flag[fresh]
        new = np.ones(len(self.key), dtype=bool)
        new[1:] = self.key[1:] != self.key[:-1]
        self.begin = np.flatnonzero(new)
        self.count = np.diff(np.append(self.begin, len(self.key)))
        self.any_flag = np.logical_or.reduceat(self.flag, self.begin) if len(self.begin) else np.empty(0, dtype=bool)

    def rows(self, chosen: np.ndarray) -> np.ndarray:
        """Which entries belong to the chosen groups."""
        return np.repeat(chosen, self.count)

    def stars(self, chosen: np.ndarray) -> np.ndarray:
        """Pairs of the entries of chosen groups with the first of their level, and of such firsts of neighbouring levels."""
        at = np.flatnonzero(self.rows(chosen))
        if not len(at):
            return np.empty(0, dtype=PAIR)
        key, level = self.key[at], (self.tag[at] & PLACED) >> 1
        new = np.ones(len(at), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (level[1:] != level[:-1])
        heads = at[new]
        first = heads[np.cumsum(new) - 1]
        a, b = np.concatenate((at, heads[1:])), np.concatenate((first, heads[:-1]))
        ok = (self.key[a] == self.key[b]) & _near(self.tag[a], self.tag[b])
        return _pairs(self.id[a[ok]], self.id[b[ok]])

    def all_pairs(self, chosen: np.ndarray, dense: int = DENSE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of near levels within chosen groups, by whether their key is ``HALF``: 1, or else 2; groups of more than ``dense`` times their entries give none and are no longer chosen."""
        for n in np.unique(self.count[chosen]):
            if n < 2:
                continue
            at = np.flatnonzero(chosen & (self.count == n))
            i, j = np.triu_indices(n, 1)
            step = max(1, STEP // len(i))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                a, b = self.begin[some, None] + i, self.begin[some, None] + j
                ok = _near(self.tag[a], self.tag[b])
                many = ok.sum(axis=1) > dense * n
                chosen[some[many]] = False
                ok[many] = False
                half = np.broadcast_to((self.key[self.begin[some]] & HALF != 0)[:, None], ok.shape)[ok]
                a, b = self.id[a[ok]], self.id[b[ok]]
                yield _summed(_pairs(a, b), np.where(half[a != b], 1, 2))


def _bytes(key: np.ndarray, item: np.ndarray, tag: np.ndarray) -> np.ndarray:
    out = np.empty((len(key), WIDTH), dtype=np.uint8)
    out[:, :6] = np.ascontiguousarray(key).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, 2:]
    out[:, 6:14] = np.ascontiguousarray(item).astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)
    out[:, 14:] = np.ascontiguousarray(tag).astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    return out


def _planes(rows: np.ndarray) -> bytes:
    """Each byte of all rows beside the next, as sorted keys then shrink when the shuffle packs them."""
    return np.ascontiguousarray(rows.T).tobytes()


def _unpacked(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.concatenate([np.empty((0, WIDTH), dtype=np.uint8), *(np.frombuffer(x, dtype=np.uint8).reshape(WIDTH, -1).T for x in parts)])
    tag = np.ascontiguousarray(raw[:, 14:])
    key = np.zeros((len(raw), 8), dtype=np.uint8)
    key[:, 2:] = raw[:, :6]
    return key.view("<u8").ravel(), np.ascontiguousarray(raw[:, 6:14]).view("<i8").ravel(), tag.view("<u4").ravel()


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    """Buckets in the order of keys."""
    return ((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _packed(kind: int, key: np.ndarray, item: np.ndarray, tag: np.ndarray, n: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(key)
    key = key[order]
    rows, bucket = _bytes(key, item[order], tag[order]), _bucket(key, n)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(key) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(key)]):
        yield kind, int(bucket[lo]), _planes(rows[lo:hi])


def _block(e: np.ndarray, n: int) -> Iterator[tuple[int, int, bytes]]:
    """Packed rows of a block of entries."""
    key, item, tag = (np.ascontiguousarray(e[c]) for c in ("key", "id", "tag"))
    g = Groups(key, item, tag)
    large = g.count > LOCAL
    inside = g.rows(large)
    keep = [np.concatenate((x[g.alone], y[~inside])) for x, y in ((key, g.key), (item, g.id), (tag, g.tag))]
    yield from _packed(KEY, *keep, n)
    if large.any():
        stars = _unique(g.stars(large))
        where = _tokens.mix(stars["a"].view("<u8") ^ (stars["b"].view("<u8") << np.uint64(1)))
        order = np.argsort(where)
        bucket = _bucket(where[order], n)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(bucket)]):
            yield PAIRS, int(bucket[lo]), stars[order[lo:hi]].tobytes()
        head = np.zeros(len(g.key), dtype=bool)
        head[g.begin[large]] = True
        # A key's members go by item, as very many may share the key.
        where = _tokens.mix(g.id[inside].view("<u8"))
        order = np.argsort(where)
        rows, bucket = _bytes(g.key[inside][order], g.id[inside][order], g.tag[inside][order]), _bucket(where[order], n)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for lo, hi in zip(cuts, [*cuts[1:], len(bucket)]):
            yield MEMBER, int(bucket[lo]), _planes(rows[lo:hi])
        yield from _packed(HEAD, g.key[head], g.id[head], g.tag[head], n)


def _rows(kind: int, x: np.ndarray, y: np.ndarray, tag: np.ndarray | None = None, step: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    kinds = np.full(step, kind, dtype=np.int32)
    for i in range(0, len(x), step):
        part = slice(i, i + step)
        n = len(x[part])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kinds[:n]), pa.array(np.ascontiguousarray(x[part]).view("<i8")), pa.array(np.ascontiguousarray(y[part]).view("<i8")),
                pa.nulls(n, pa.int32()) if tag is None else pa.array(tag[part].astype(np.int32)), *(pa.nulls(n, of) for _, of in _OF_NODES),
            ],
            schema=_ROWS,
        )


def _node_rows(nodes: pa.RecordBatch) -> pa.RecordBatch:
    n, none = nodes.num_rows, pa.nulls
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, NODE, dtype=np.int32)), nodes.column(0), none(n, pa.int64()), none(n, pa.int32()), *nodes.columns[1:]], schema=_ROWS)


def _bucket_rows(got: dict[int, list[bytes]], paired: int, dense: int) -> Iterator[pa.RecordBatch]:
    if not got[KEY] and not got[HEAD] and not got[PAIRS]:
        return
    plain, heads = _unpacked(got[KEY]), _unpacked(got[HEAD])
    flag = np.repeat([False, True], [len(plain[0]), len(heads[0])])
    g = Groups(*(np.concatenate(x) for x in zip(plain, heads)), flag)
    whole = ~g.any_flag & (g.count <= paired)
    few = list(g.all_pairs(whole, dense))
    stars = np.concatenate([np.frombuffer(b"".join(got[PAIRS]), dtype=PAIR), g.stars(~whole)])
    pairs, weight = _summed(np.concatenate([stars, *(x for x, _ in few)]), np.concatenate([np.full(len(stars), 2), *(w for _, w in few)]))
    yield from _rows(PAIRS, pairs["a"], pairs["b"], np.minimum(weight, 2))
    rest = g.rows(~whole)
    yield from _rows(MEMBER, g.key[rest], g.id[rest], g.tag[rest])


def _gather(paired: int, dense: int) -> Callable:
    """Works off one bucket after the other; rows come in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, got = None, {PAIRS: [], KEY: [], HEAD: []}
        for batch in batches:
            for kind, at, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at != bucket:
                    yield from _bucket_rows(got, paired, dense)
                    bucket, got = at, {PAIRS: [], KEY: [], HEAD: []}
                data = payload.as_buffer()
                if kind == NODE:
                    yield _node_rows(pa.ipc.read_record_batch(data, NODES))
                elif kind == MEMBER:
                    key, item, tag = _unpacked([data])
                    yield from _rows(MEMBER, key, item, tag)
                else:
                    got[kind].append(bytes(data))
        yield from _bucket_rows(got, paired, dense)

    return run


def keyed(frame: DataFrame, keys_of: Callable, paired: int = PAIRED, turns: int = 1, dense: int = DENSE) -> DataFrame:
    """Pairs (x, y; tag 1 if a single ``HALF`` key gave it in a bucket), members of large keys (key x, item y, tag) and nodes, each of its kind.

    ``keys_of`` turns an iterator of record batches of ``frame`` into arrays of ``ENTRY`` and
    record batches of ``NODES``, so that ``frame`` is read once in a turn.  Each turn takes
    its share of all keys and frees what it has shuffled before the next one.
    """
    rows = [_keyed(frame, keys_of, paired, dense, turn, turns) for turn in range(turns)]
    return functools.reduce(DataFrame.unionAll, rows)


def _keyed(frame: DataFrame, keys_of: Callable, paired: int, dense: int, turn: int, turns: int) -> DataFrame:
    spark = frame.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out(rows) -> pa.RecordBatch:
            kinds, buckets, payloads = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], ["kind", "bucket", "payload"])

        for got in keys_of(batches):
            if isinstance(got, pa.RecordBatch):
                if turn:
                    continue
                data = got.serialize().to_pybytes()
                yield out([(NODE, zlib.crc32(data) % n, data)])
                continue
            if turns > 1:
                got = got[(got["key"] >> np.uint64(16)) % np.uint64(turns) == turn]
            held.append(got)
            size += len(got)
            if size >= BLOCK:
                yield out(_block(np.concatenate(held), n))
                held, size = [], 0
        if size:
            yield out(_block(np.concatenate(held), n))

    with arrow_rows(spark, ARROW_ROWS):
        packed = frame.mapInArrow(_tokens.tidy(run), PACKED).repartition("bucket").sortWithinPartitions("bucket")
    with arrow_rows(spark, ARROW_ROWS // 8):
        rows = materialize(packed.mapInArrow(_tokens.tidy(_gather(paired, dense)), ROWS), "keyed")
    del packed
    reclaim(spark)
    return rows


def _forest(a: np.ndarray, b: np.ndarray, comp: np.ndarray, turn: int) -> np.ndarray:
    """Of the index pairs, as many as join the components that they can join."""
    label = np.unique(comp, return_inverse=True)[1]
    order = np.argsort(_tokens.mix(a.astype(np.uint64) * np.uint64(len(comp)) + b.astype(np.uint64) + np.uint64(turn << 40)), kind="stable")
    a, b = a[order], b[order]
    chosen = []
    while True:
        x, y = label[a], label[b]
        across = np.flatnonzero(x != y)
        if not len(across):
            return order[np.unique(np.concatenate(chosen))] if chosen else np.empty(0, dtype=np.int64)
        # Every component but the least of its neighbours takes its first pair to a lesser one.
        more, less = np.maximum(x, y)[across], np.minimum(x, y)[across]
        top, at = np.unique(more, return_index=True)
        chosen.append(across[at])
        to = np.arange(label.max() + 1)
        to[top] = less[at]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _candidates(rows: dict, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a tile that lie in different components and that ``keep`` lets pass."""
    left = np.flatnonzero(rows["part"] == rows["i"])
    right = np.flatnonzero(rows["part"] == rows["j"])
    found = []
    for some in np.array_split(left, max(1, len(left) * len(right) // STEP)):
        a, b = np.repeat(some, len(right)), np.tile(right, len(some))
        ok = (rows["comp"][a] != rows["comp"][b]) & ((rows["i"][a] != rows["j"][a]) | (a < b)) & _near(rows["tag"][a], rows["tag"][b])
        a, b = a[ok], b[ok]
        if len(a):
            ok = keep(rows["size"], rows["mark"], a, b)
            found.append((a[ok], b[ok]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 2


def _each_tile(batches: Iterator[pa.RecordBatch], objects: tuple[str, ...]) -> Iterator[dict]:
    """The rows of one tile after the other, as arrays by column."""
    rest: dict | None = None
    for batch in batches:
        now = {}
        for c in batch.schema.names:
            if c in objects:
                now[c] = np.empty(batch.num_rows, dtype=object)
                now[c][:] = batch.column(c).to_pylist()
            else:
                # With nulls, numbers would come as floats, which round ids.
                now[c] = batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False)
        if rest is not None:
            now = {c: np.concatenate((rest[c], now[c])) for c in now}
        change = np.flatnonzero((now["key"][1:] != now["key"][:-1]) | (now["i"][1:] != now["i"][:-1]) | (now["j"][1:] != now["j"][:-1])) + 1
        cuts = [0, *change]
        for lo, hi in zip(cuts, cuts[1:]):
            yield {c: v[lo:hi] for c, v in now.items()}
        rest = {c: v[cuts[-1] :] for c, v in now.items()}
    if rest is not None and len(rest["key"]):
        yield rest


def _tiles(keep: Callable, turn: int | None) -> Callable:
    """The candidates of each tile; with a turn, a forest of them.  In turn 0 also the items of those passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_tile(batches, ("mark",)):
            a, b = _candidates(rows, keep)
            if not len(a):
                continue
            if turn == 0:
                ids = rows["id"][np.unique(np.concatenate((a, b)))]
                yield from _rows(LATER, ids, np.zeros_like(ids))
            if turn is not None:
                few = _forest(a, b, rows["comp"], turn)
                a, b = a[few], b[few]
            yield from _rows(KEY, rows["key"][:1], np.zeros(1, dtype=np.int64))
            pairs = _unique(_pairs(rows["id"][a], rows["id"][b]))
            yield from _rows(PAIRS, pairs["a"], pairs["b"])

    return run


def _first_met(before: np.ndarray, a: np.ndarray, b: np.ndarray, probed: np.ndarray | None = None, level: np.ndarray | None = None) -> np.ndarray:
    """Whether the items of index pairs meet by no lesser key, so that no other tile has the pair.

    before: an item's lesser keys.  probed: those that it only probes, by which it meets no
    item that probes them, too.  With the items' levels, a key has its place in the last 16
    bits, and items do not meet by a key that they have at places too far apart.
    """
    n = np.array([len(x) for x in before])
    out = np.ones(len(a), dtype=bool)
    if not n.any():
        return out
    all_ = np.concatenate([np.asarray(x, dtype=np.int64) for x in before])
    place, owner = np.zeros_like(all_) if level is None else all_ & PLACES, np.repeat(np.arange(len(before)), n)
    keys, at = np.unique(all_ if level is None else all_ >> 16, return_inverse=True)
    probes = np.zeros(len(all_), dtype=bool)
    if probed is not None and any(len(x) for x in probed):
        probes = np.concatenate([np.isin(x, y) for x, y in zip(before, probed)])
    met = _common(owner, at, probes, len(before))[a, b]
    if level is None:
        return met == 0
    out = met == 0
    # Items that have a key within one cell of places are near there; the others that have one in common are looked at key by key.
    cell = at * (PLACES + 1) + place // SHIFT[level.min()]
    near = _common(owner, np.unique(cell, return_inverse=True)[1], probes, len(before))[a, b] > 0
    open_ = np.flatnonzero(~out & ~near)
    # By item and key, twice the place counted from 1, and whether it is only probed; 0 if the item does not have the key.
    has = np.zeros((len(before), len(keys) if len(open_) else 0), dtype=np.int32)
    if len(open_):
        has[owner, at] = 2 * (place + 1) + probes
        out[open_] = True
    begin, most = np.cumsum(n) - n, SHIFT[np.maximum(level[a], level[b])]
    for some in np.array_split(open_, len(open_) // 4096 + 1):
        many = n[b[some]]
        pair = np.repeat(some, many)
        mine = np.arange(many.sum()) + np.repeat(begin[b[some]] - (np.cumsum(many) - many), many)
        other = has[a[pair], at[mine]]
        shared = np.flatnonzero((other > 0) & ~((other & 1 == 1) & probes[mine]))
        p, q, pair = (other[shared] >> 1) - 1, place[mine[shared]], pair[shared]
        out[pair[(p == 0) | (q == 0) | (np.abs(p - q) <= most[pair])]] = False
    return out


def _common(owner: np.ndarray, at: np.ndarray, probes: np.ndarray, n: int) -> np.ndarray:
    """How many of the things ``at`` each two of n items have in common that not both only probe."""
    has = np.zeros((n, at.max() + 1), dtype=np.float32)
    has[owner, at] = 1
    common = has @ has.T
    if probes.any():
        has[:] = 0
        has[owner[probes], at[probes]] = 1
        common -= has @ has.T
    return common


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after the items of pairs have become one component."""
    while True:
        lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (lo == hi).all():
            return label
        to = np.arange(len(label))
        np.minimum.at(to, hi, lo)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _meetings(keep: Callable) -> Callable:
    """Of each tile one row with its candidates, as packed index pairs, and a row for each item in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_tile(batches, ("mark", "before", "probed")):
            a, b = _candidates(rows, keep)
            if len(a):
                ok = _first_met(rows["before"], a, b, rows["probed"], (rows["tag"].astype(np.int64) & 255) >> 1)
                a, b = a[ok], b[ok]
            if not len(a):
                continue
            used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            n = len(used) + 1
            same = lambda c: pa.array(np.full(n, rows[c][0]))
            yield pa.RecordBatch.from_arrays(
                [
                    same("key"), same("i"), same("j"), pa.array(np.arange(-1, n - 1, dtype=np.int32)), pa.array([None, *rows["id"][used]], pa.int64()),
                    pa.array([None, *rows["comp"][used]], pa.int64()), pa.array([at.astype("<u2").tobytes(), *[None] * (n - 1)], pa.binary()),
                ],
                ["key", "i", "j", "idx", "id", "comp", "pairs"],
            )

    return run


MET = "key long, i int, j int, idx int, id long, comp long, pairs binary"


def _settle(within: Callable) -> Callable:
    """The linked pairs among the candidates of tiles, as many as join what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in _each_tile(batches, ("pairs", "text")):
            a, b = np.frombuffer(rows["pairs"][0], dtype="<u2").reshape(2, -1)
            item = {c: rows[c][1:] for c in ("id", "comp", "text")}
            held.append((item["id"][a].astype(np.int64), item["id"][b].astype(np.int64), item["id"].astype(np.int64), item["comp"].astype(np.int64), item["text"]))
            size += len(a)
            if size >= STEP >> 4:
                yield from linked(held)
                held, size = [], 0
        if held:
            yield from linked(held)

    def linked(held: list) -> Iterator[pa.RecordBatch]:
        a, b, ids, comps, texts = (np.concatenate(x) for x in zip(*held))
        ids, first = np.unique(ids, return_index=True)
        texts = texts[first]
        label = np.unique(comps[first], return_inverse=True)[1]
        a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
        for turn in (*range(FORESTS), None):
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
            now = np.ones(len(a), dtype=bool)
            if turn is not None and len(a):
                now[:] = False
                now[_forest(a, b, label, turn)] = True
            ok = within([texts[i] for i in a[now]], [texts[i] for i in b[now]])
            x, y = a[now][ok], b[now][ok]
            label = _joined(label, x, y)
            a, b = a[~now], b[~now]
            pairs = _pairs(ids[x], ids[y])
            yield from _rows(PAIRS, pairs["a"], pairs["b"])

    return run


class Contents:
    """``(id, text)`` of items that were asked for; each is read from one document, and kept for the next time.

    docs: ``(doc_id, text_key, text)``.  nodes: ``(id, place)``, where ``place`` hashes
    text_key and doc_id of a document that has the item.  ``extract`` turns ``(ids, text)``,
    a document and the items wanted of it, into ``(id, text)``.
    """

    def __init__(self, docs: DataFrame, nodes: DataFrame, extract: Callable[[DataFrame], DataFrame]):
        self.docs, self.nodes, self.extract, self.tables = docs, nodes, extract, []

    def all(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionAll(t)
        return out

    def read(self, ids: DataFrame) -> None:
        if self.tables:
            ids = ids.join(self.all().select("id"), "id", "left_anti")
        wanted = materialize(ids.join(self.nodes.select("id", "place"), "id").groupBy("place").agg(F.collect_list("id").alias("ids")), "wanted")
        if self.tables and wanted.isEmpty():
            return
        rows = self.docs.select(place().alias("place"), "text").join(small(wanted), "place").select("ids", "text")
        with arrow_rows(self.docs.sparkSession, ARROW_ROWS):
            self.tables.append(materialize(self.extract(rows).groupBy("id").agg(F.first("text").alias("text")), "contents"))
        release(wanted)

    def beside(self, pairs: DataFrame) -> DataFrame:
        """``(a, b, text_a, text_b)`` of pairs whose contents were read."""
        texts = self.all()
        for c in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")), c)
        return pairs.select("a", "b", "text_a", "text_b")


def place():
    return F.xxhash64("text_key", "doc_id")


def signed(pairs: DataFrame, nodes: DataFrame, within: str, keep: Callable) -> DataFrame:
    """The pairs that the sizes, by the condition ``within``, and signatures of their items let pass."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                size = np.concatenate([batch.column(c).to_numpy() for c in ("size_a", "size_b")])
                mark = np.empty(2 * n, dtype=object)
                mark[:] = batch.column("mark_a").to_pylist() + batch.column("mark_b").to_pylist()
                yield batch.select(["a", "b"]).filter(pa.array(keep(size, mark, np.arange(n), np.arange(n, 2 * n))))

    both = pairs.select("a", "b")
    for c in ("a", "b"):
        both = both.join(nodes.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("mark").alias(f"mark_{c}")), c)
    return both.where(within).select("a", "b", "size_a", "size_b", "mark_a", "mark_b").mapInArrow(_tokens.tidy(check), "a long, b long")


def _dealt(now: DataFrame, mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of mixed keys, each row once for every tile that it is in."""
    # Items of the largest component stand in parts of their own and meet only the rest.
    is_top = F.col("comp") == F.col("top")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    part = F.when(F.col("one"), 0).when(is_top, F.col("p_rest") + deal("p_top")).otherwise(deal("p_rest"))
    meets = F.when(F.col("one"), 0).when(is_top, F.col("p_rest") - 1).otherwise(F.col("p_rest") + F.col("p_top") - 1)
    rest = [c for c in now.columns if c != "key"]
    sides = now.join(small(mixed), "key").withColumn("part", part).withColumn("meets", meets).select("key", *rest, "part", "meets").join(nodes, "id")
    each = sides.withColumn("other", F.explode(F.expr("sequence(0, meets)"))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    return each.drop("meets", "other").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _parted(members: DataFrame) -> DataFrame:
    """``members`` with keys of more than a tile parted by level and place, so that linked items still have a part in common.

    A part has two bands of levels and of places, an item is in those of its own bands and of
    the ones before them, and bands are as wide as linked items can lie apart.
    """
    half = F.col("key").bitwiseAND(int(HALF)) != 0
    large = materialize(members.where(half).groupBy("key").agg(F.count("*").alias("n")).where(f"n > {TILE}").select("key"), "large")
    level, place = F.shiftright(F.col("tag").bitwiseAND(255), 1), F.shiftright(F.col("tag"), 8).bitwiseAND(PLACES)
    band = F.floor(level / BAND).cast("int")
    each = members.join(small(large), "key", "left_semi").withColumn("band", F.explode(F.array(band - 1, band)))
    reach = F.get(F.array(*(F.lit(int(x)) for x in SHIFT)), F.least(F.col("band") * BAND + 2 * BAND - 1, F.lit(LEVELS)))
    at = F.floor(place / reach).cast("int")
    # What has no place meets all.
    each = each.withColumn("at", F.explode(F.when(place == 0, F.sequence(F.lit(-1), F.lit(PARTS))).otherwise(F.array(at - 1, at))))
    key = F.xxhash64("key", "band", "at").bitwiseAND(~(int(HALF) | 0xFFFF)).bitwiseOR(int(HALF))
    rest = members.join(small(large), "key", "left_anti")
    out = materialize(rest.select("key", "id", "tag").unionAll(each.select(key.alias("key"), "id", "tag")).distinct(), "members")
    release(large)
    return out


def _mixed(now: DataFrame) -> DataFrame:
    """Keys whose members (key, id, comp) lie in several components, with the largest of these and how tiles part the key."""
    each = now.groupBy("key", "comp").agg(F.count("*").alias("n"))
    each = each.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    tile = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    mixed = each.select("key", F.col("top.comp").alias("top"), F.col("top.n").alias("n_top"), (F.col("all") - F.col("top.n")).alias("n_rest"), (F.col("all") <= TILE).alias("one"))
    return materialize(mixed.withColumn("p_top", tile("n_top")).withColumn("p_rest", tile("n_rest")), "mixed")


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    at = comps.select(F.col("node").alias("id"), F.col("component").alias("comp"))
    return materialize(members.join(at, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "placed")


def _of(frame: DataFrame, kind: int, *names: str) -> DataFrame:
    return frame.where(F.col("kind") == kind).select(*(F.col(c).alias(n) for c, n in zip("xy", names)))


def _first_components(rows: DataFrame, verify: Callable) -> tuple[DataFrame, DataFrame]:
    """Components of the links among gathered pairs, and the members of large keys."""
    pairs = rows.where(F.col("kind") == PAIRS).groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("tag").alias("weight"))
    links = materialize(verify(pairs.where("weight > 1").select("a", "b"), None), "links")
    reclaim(rows.sparkSession)
    comps = materialize(connected_components(links), "components")
    release(links)
    members = rows.where(F.col("kind") == MEMBER).select(F.col("x").alias("key"), F.col("y").alias("id"), F.col("tag").bitwiseAND(PLACED).alias("tag")).distinct()
    return comps, materialize(members, "members")


def settled_components(rows: DataFrame, nodes: DataFrame, verify: Callable, keep: Callable, contents: Contents, within: Callable) -> DataFrame:
    """``(node, component)`` of every item that has a link, where contents are short.

    As ``components``, but tiles only list their candidates, a pair in the tile of the least
    key that it has in common; contents of the items concerned then go to the tiles, which
    verify candidates by ``within(texts, texts)`` until their components are settled.
    """
    comps, gathered = _first_components(rows, verify)
    members = _parted(gathered)
    release(gathered)
    now = _placed(members, comps)
    mixed = _mixed(now)
    shares = now.join(small(mixed.select("key")), "key", "left_semi")
    # The last 16 bits of a key are free.
    key = F.col("key").bitwiseOR(F.shiftright("tag", 8).cast("long"))
    keys = shares.groupBy("id").agg(F.collect_set(key).alias("keys"), F.collect_set(F.when(F.col("tag") % 2 == 0, key)).alias("own"))
    known = nodes.select("id", "size", "mark").join(keys.select("id", "keys", F.array_except("keys", "own").alias("probes")), "id")
    lesser = lambda c: F.filter(c, lambda k: k < F.col("key"))
    tiled = _dealt(now, mixed, known).withColumn("before", lesser("keys")).withColumn("probed", lesser("probes")).drop("keys", "probes")
    spark = rows.sparkSession
    with arrow_rows(spark, ARROW_ROWS):
        met = materialize(tiled.mapInArrow(_tokens.tidy(_meetings(keep)), MET), "met")
    release(now, mixed)
    reclaim(spark)
    contents.read(met.where("idx >= 0").select("id").distinct())
    beside = met.where("idx >= 0").join(contents.all(), "id").unionByName(met.where("idx < 0").withColumn("text", F.lit(None).cast("string")))
    beside = beside.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "idx")
    with arrow_rows(spark, ARROW_ROWS // 4):
        links = materialize(_of(beside.mapInArrow(_tokens.tidy(_settle(within)), ROWS), PAIRS, "a", "b"), "links")
    out = materialize(joined_components(comps, links), "components")
    release(comps, members, met, links)
    reclaim(spark)
    return out


def components(rows: DataFrame, nodes: DataFrame, verify: Callable[[DataFrame, DataFrame], DataFrame], keep: Callable) -> DataFrame:
    """``(node, component)`` of every item that has a link.

    rows: from ``keyed``.  nodes: one row for each item, ``(id, size, mark)``.  ``verify``
    turns distinct pairs ``(a, b)`` into those that are linked; it also gets the ids of
    items that it will be asked about again.  ``keep(size, mark, a, b)`` says which index
    pairs of a tile can be linked at all.
    """
    spark = rows.sparkSession
    relieve(spark)  # an executor else keeps what gathering keys has taken, and buffers of whole texts in each round, until it is out of memory
    comps, members = _first_components(rows, verify)
    relieve(spark)
    for turn in (*range(FORESTS), None):
        now = _placed(members, comps)
        mixed = _mixed(now)
        with arrow_rows(spark, ARROW_ROWS):
            given = materialize(_dealt(now, mixed, nodes.select("id", "size", "mark")).mapInArrow(_tokens.tidy(_tiles(keep, turn)), ROWS), "tiles")
        release(now, mixed)
        rest = _of(given, PAIRS, "a", "b").distinct()
        if rest.isEmpty():
            release(given)
            break
        more = materialize(verify(rest, _of(given, LATER, "id").distinct()), "links")
        # A key whose tiles gave no pair never will: components only grow.
        old, members = members, materialize(members.join(small(_of(given, KEY, "key").distinct()), "key", "left_semi"), "members")
        before, comps = comps, materialize(joined_components(comps, more), "components")
        release(old, given, more, before)
        reclaim(spark)
        relieve(spark)
    release(members)
    return comps
