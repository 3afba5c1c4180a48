"""Document fingerprints from closed syncmers of words, in native columns only.

A run of ``K`` words is an anchor if the smallest hash among its inner runs of ``S`` words
stands at its first or last place.  Whether a run is an anchor depends on its own words
alone, so texts that share a passage share its anchors wherever the passage stands.  A
fingerprint has all anchors of the whole text in their order, with their positions beside
it; two are compared by the Jaccard index of their sets of anchors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._spans import let

K, S = 8, 2
_BITS = (1 << 48) - 1
#: Ranges of doc_ids from whose bounds buckets are cut.
KNOTS = 128
#: Most documents of a bucket on average.
BUCKET_ROWS = 16384
#: Buckets whose heads' copy to every executor is proven small.
BROADCAST_HEADS = 1 << 16
#: Documents of one doc_id follow each other by so many code points, then by the hash of the text.
HEAD_CHARS = 256


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def _places(words: Column, k: int, s: int) -> Column:
    """First words of all closed syncmers, from 0."""
    inner = F.transform(F.sequence(F.lit(0), F.size(words) - s), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(s))))

    def closed(g: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(g) - (k - s + 1)),
            lambda i: F.array_min(F.slice(g, i + 1, F.lit(k - s + 1))) == F.least(F.get(g, i), F.get(g, i + (k - s))),
        )

    return let(inner, closed)


def fingerprint(text: Column, k: int = K, s: int = S) -> Column:
    """``struct<position: array<int>, anchor: array<bigint>>``: all anchors (48 bits) in order of their first word, from 0.

    A text of fewer than ``k`` words has one anchor, all of its words; one without words has
    none.
    """

    def of(words: Column) -> Column:
        mark = lambda h: h.bitwiseAND(F.lit(_BITS))
        places = F.when(F.size(words) >= k, _places(words, k, s)).when(F.size(words) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        run = lambda i: F.when(F.size(words) >= k, mark(F.xxhash64(F.slice(words, i + 1, F.lit(k))))).otherwise(mark(F.xxhash64(words)))
        return let(places.cast("array<int>"), lambda p: F.struct(p.alias("position"), F.transform(p, run).alias("anchor")))

    return let(_words(F.coalesce(text, F.lit(""))), of)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two arrays of anchors; 1 for equal ones, two empty ones among them."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def shown(marks: Column) -> Column:
    """Anchors as text: twelve hexadecimal digits for each."""
    return F.array_join(F.transform(marks, lambda m: F.lpad(F.lower(F.hex(m)), 12, "0")), "")


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """``(doc_id, position, anchor)``: every anchor of every text, for positional matching."""
    both = docs.select("doc_id", fingerprint(F.col("text"), k, s).alias("marks"))
    return both.select("doc_id", F.inline(F.arrays_zip("marks.position", "marks.anchor")).alias("position", "anchor"))


def _prefix(text: Column) -> Column:
    """The first seven bytes as a number, in the order of texts."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def _buckets(rows: DataFrame) -> Column:
    """Buckets of rows (at, text) in the order of at, null last, and text.

    Ranges of ``at`` are cut evenly.  Rows of one ``at`` that fill more than a range, and
    rows of none, are cut by the beginnings of their texts.  Only bounds come to the driver,
    some hundreds.
    """
    spark = rows.sparkSession
    cuts = [i / KNOTS for i in range(1, KNOTS)]
    got = rows.agg(F.count("*").alias("n"), F.count("at").alias("given"), F.min("at").alias("low"), F.max("at").alias("high"), F.percentile_approx("at", cuts, 1000).alias("cuts")).first()
    n, low, high = got["n"], got["low"], got["high"]
    most = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(min(n // 64, most), -(-n // BUCKET_ROWS), 1)
    knots = [low, *(got["cuts"] or [])] if low is not None else []
    bounds = sorted(set(knots))
    hot = sorted({x for x in knots if knots.count(x) > 2})
    least = max(64, n // wanted)
    steps: dict = {}
    if hot or n - got["given"] > least:
        chosen = rows.where(F.col("at").isNull() | F.col("at").isin(hot)) if hot else rows.where("at is null")
        per = [i / 1000 for i in range(1, 1000)]
        for r in chosen.groupBy("at").agg(F.count("*").alias("k"), F.percentile_approx(_prefix(F.col("text")), per, 10000).alias("p")).collect():
            every = max(1, 1000 // min(1000, max(1, r["k"] // least)))
            steps[r["at"]] = sorted(set(r["p"][every - 1 :: every]))
    parts = -(-wanted // max(1, len(bounds)))
    wide = max([len(x) + 1 for x in steps.values()], default=1)
    prefix = _prefix(F.col("text"))
    numbers = lambda of: F.lit(np.array(of, dtype=np.int64))
    inner = lambda at: F.size(F.filter(numbers(steps[at]), lambda p: p <= prefix)).cast("bigint") if steps.get(at) else F.lit(0).cast("bigint")
    bucket = None
    if bounds:
        # Bounds are looked up in one array: a case for each would be copied with every plan that names the bucket.
        per = [max(1, -(-(end - start) // parts)) for start, end in zip(bounds, [*bounds[1:], high + 1])]
        i = F.size(F.filter(numbers(bounds), lambda b: b <= F.col("at"))) - 1
        of = lambda i: F.least(F.floor((F.col("at") - F.get(numbers(bounds), i)) / F.get(numbers(per), i)).cast("bigint"), F.lit(parts - 1)) + wide
        within = let(i, lambda i: F.struct(i.alias("i"), of(i).alias("part")))
        part = lambda w: w["part"]
        for start in reversed([x for x in bounds if x in steps]):
            part = lambda w, start=start, rest=part: F.when(F.col("at") == F.lit(start), inner(start)).otherwise(rest(w))
        bucket = let(within, lambda w: part(w) + w["i"].cast("bigint") * (parts + wide))
    none = inner(None) + len(bounds) * (parts + wide)
    return none if bucket is None else F.when(F.col("at").isNull(), none).otherwise(bucket)


def _with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, marks, next_text, next_marks)``: each row beside the row after it by descending doc_id.

    Rows go to buckets of neighbouring doc_ids, each of which is ordered by itself; the
    first row of a bucket is also sent to the bucket before it.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The complement rises as doc_id falls.
    rows = rows.withColumn("at", F.bitwise_not("doc_id"))
    rows = rows.withColumn("bucket", _buckets(rows)).withColumn("head", F.left("text", F.lit(HEAD_CHARS))).withColumn("hash", F.xxhash64("text"))
    # Nulls come last: the first row of a bucket has the least complement, of ties the least text.
    first = F.struct(F.col("at").isNull().alias("none"), "at", "head", "hash")
    heads = rows.groupBy("bucket").agg(F.min(first).alias("first"))
    whole = Window.partitionBy()
    heads = heads.withColumn("prior", F.lag("bucket").over(Window.orderBy("bucket"))).withColumn("last", F.max("bucket").over(whole))
    heads = heads.select("bucket", "first", F.coalesce("prior", "last").alias("to"))
    # Only the key of a head was gathered; its text is read again.
    guests = rows.join(F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads, "bucket").where(F.col("hash") == F.col("first.hash")).where(F.col("at").eqNullSafe(F.col("first.at")))
    guests = guests.groupBy("to").agg(F.min_by(F.struct("doc_id", "text", "at", "head", "hash"), "hash").alias("g"))
    guests = guests.select(F.col("to").alias("bucket"), "g.*", F.lit(1).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(0)).unionByName(guests).repartition("bucket").withColumn("marks", fingerprint(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("at").asc_nulls_last(), "head", "hash")
    return (
        dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_marks", F.lead(F.col("marks.anchor")).over(order))
        .where("guest = 0").select("doc_id", "text", "marks", "next_text", "next_marks")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): fingerprints of the text and of its edited form.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, positions``, the last with the first word of each anchor of ``fingerprint``.  The edited form has its last ``floor(n_chars / 2)`` code points replaced
    by the first as many, or all, of the next document by descending doc_id; after the last
    comes the first.  Null texts count as empty.  Null doc_ids come last; rows of one doc_id
    follow each other by the first ``HEAD_CHARS`` code points of the text, then by its hash.  Other columns are not read.
    """
    n = F.char_length("text").cast("bigint")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")), F.expr("next_text").substr(F.lit(1), half))
    out = _with_next(docs).withColumn("n_chars", n).withColumn("edited", edited).withColumn("edited_marks", fingerprint(F.col("edited")))
    own, changed = F.col("marks.anchor"), F.col("edited_marks.anchor")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(own).alias("fingerprint"), shown(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"), likeness(own, F.col("next_marks")).alias("near_next"), F.col("marks.position").alias("positions"),
    )
