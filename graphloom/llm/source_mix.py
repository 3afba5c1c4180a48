"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words.  Every document of a source is taken as many whole
times as the target holds the source.  Of what is left, documents whose inclusion
probability, in proportion to their weight, would reach 1 are certain and taken once more;
the others are a sample without replacement of fixed size in words: they are ranked by the
odds of a random number over the odds of their inclusion probability, and the first ones
are taken until the words suffice.  The
ranking's cut is found by two rounds of sums over bins of the rank, so that no source is
ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.shared import materialize

#: Weights of sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, and the most of a source, as multiples of half its size.
SHARE_HALVES, CAP_HALVES = 3, 4
SEED = "mix-1"
BINS = 4096
BROADCAST_SOURCES = 1 << 16


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+", -1))).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from one row for each source.

    Water-filling in whole numbers: by rising ratio of cap to weight, a source is at its cap
    if the level reached without it would pass that cap; the rest share what is left.
    Windows without a key run over one row for each source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    at = sizes.withColumn("weight", weight.cast("bigint")).withColumn("total", F.sum("source_size").over(every))
    at = at.withColumn("before", F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    capped = (F.lit(SHARE_HALVES) * F.col("total") - F.lit(CAP_HALVES) * F.col("before")) * F.col("weight") >= F.lit(CAP_HALVES) * F.col("source_size") * F.col("rest")
    at = at.withColumn("capped", capped)
    at = at.withColumn("held", F.sum(F.when(F.col("capped"), F.col("source_size")).otherwise(0)).over(every))
    at = at.withColumn("free", F.sum(F.when(F.col("capped"), F.lit(0)).otherwise(F.col("weight"))).over(every))
    level = (F.lit(SHARE_HALVES) * F.col("total") - F.lit(CAP_HALVES) * F.col("held")) * F.col("weight") / F.nullif(2 * F.col("free"), F.lit(0))
    target = F.when(F.col("capped"), (F.lit(CAP_HALVES) * F.col("source_size") / 2).cast("double")).otherwise(level.cast("double"))
    return at.select("source", "source_size", target.alias("target"))


def _cut(binned: DataFrame, column: str, base: str) -> DataFrame:
    """For each source, the bin in which the running words reach ``rest``, and the words before it."""
    sums = binned.groupBy("key", column).agg(F.sum("size").alias("in_bin"), F.first("rest").alias("rest"), F.first(base).alias(base))
    order = Window.partitionBy("key").orderBy(column)
    run = sums.withColumn("upto", F.col(base) + F.sum("in_bin").over(order))
    return (
        run.where("upto >= rest")
        .groupBy("key")
        .agg(F.min(F.struct(F.col(column).alias("bin"), (F.col("upto") - F.col("in_bin")).alias("words"))).alias("c"))
        .select("key", F.col("c.bin").alias(f"cut_{column}"), F.col("c.words").alias(f"words_{column}"))
    )


def _certain(classes: DataFrame) -> DataFrame:
    """``(key, sure, rest, weighted)`` from the words of each weight of a source (key, weight, words, want).

    Documents of weight ``sure`` or more are certain, ``rest`` is wanted of the others, and
    ``weighted`` is the sum of their words times weight.  From the greatest weight down, a
    weight is certain if its share of what greater ones leave reaches all its words; then
    so do greater ones.  A source has 64 weights at most.
    """
    down = Window.partitionBy("key").orderBy(F.desc("weight"))
    up = Window.partitionBy("key").orderBy("weight")
    at = classes.withColumn("greater", F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = at.withColumn("upto", F.sum(F.col("words") * F.col("weight")).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    is_sure = (F.col("want") > F.col("greater")) & ((F.col("want") - F.col("greater")) * F.col("weight") >= F.col("upto")) & (F.col("words") > 0)
    at = at.withColumn("is_sure", is_sure)
    held = F.coalesce(F.sum(F.when(F.col("is_sure"), F.col("words"))), F.lit(0))
    weighted = F.coalesce(F.sum(F.when(~F.col("is_sure"), F.col("words") * F.col("weight"))), F.lit(0))
    return at.groupBy("key").agg(F.min(F.when(F.col("is_sure"), F.col("weight"))).alias("sure"), (F.max("want") - held).alias("rest"), weighted.alias("weighted"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): how many of its words the mix takes.

    Columns ``doc_id, size, source_size, target, taken``.  ``taken`` is the size times the
    times that the document is taken, twice at most.  A document's chance to be in the
    sampled part follows the bit length of its size, so that the mix is not filled with
    scraps.  Null texts have size 0, a null source is a source of its own, ordered last;
    null or repeated doc_ids rank by size among each other.  Reruns agree, since random
    numbers are hashes of the doc_id.  An empty table gives an empty mix.
    """
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("bigint")
    size = n_words(F.col("text"))
    light = materialize(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", size.alias("size"), number.alias("number"))
        .withColumn("weight", F.length(F.bin(F.col("size") + 1)).cast("bigint")),
        "sizes",
    )
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("bigint")
    plan = plan.withColumn("whole", whole).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    # Null sources join by a key of their own.
    plan = plan.withColumn("key", _key()).drop("source")
    classes = light.groupBy(_key().alias("key"), "weight").agg(F.sum("size").alias("words"))
    plan = materialize(plan.join(_certain(classes.join(plan.select("key", "want"), "key")), "key", "left"), "targets")
    few = plan.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda x: x)
    chance = F.col("rest") * F.col("weight") / F.nullif(F.col("weighted"), F.lit(0))
    certain = F.coalesce(F.col("weight") >= F.col("sure"), F.lit(False))
    u = (F.col("number") + 0.5) / F.lit(float(1 << 48))
    odds = (u / (1 - u)) * ((1 - F.col("chance")) / F.nullif(F.col("chance"), F.lit(0.0)))
    ranked = (
        light.withColumn("key", _key()).drop("source").join(hint(plan), "key")
        .withColumn("chance", chance)
        .withColumn("certain", certain)
        .withColumn("rank", F.when((F.col("rest") > 0) & ~F.col("certain"), 1 - 1 / (1 + odds)))
        .withColumn("fine", F.floor(F.col("rank") * (BINS * BINS)).cast("bigint"))
        .withColumn("b1", F.floor(F.col("fine") / BINS).cast("bigint"))
        .withColumn("b2", F.col("fine") - F.col("b1") * BINS)
    )
    first = materialize(_cut(ranked.where("rest > 0 and not certain").withColumn("base", F.lit(0).cast("bigint")), "b1", "base"), "cut1")
    placed = ranked.join(hint(first), "key", "left")
    second = _cut(placed.where("b1 = cut_b1"), "b2", "words_b1")
    placed = placed.join(hint(materialize(second, "cut2")), "key", "left")
    inside = F.coalesce((F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2")), F.lit(False))
    # Without a cut the words never reach what is wanted: everything is taken.
    early = (F.col("rest") > 0) & ~F.col("certain") & (F.col("cut_b1").isNull() | (F.col("b1") < F.col("cut_b1")) | ((F.col("b1") == F.col("cut_b1")) & (F.col("cut_b2").isNull() | (F.col("b2") < F.col("cut_b2")))))
    order = Window.partitionBy("key").orderBy("rank", "doc_id", "size")
    before = F.col("words_b2") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = placed.where(inside).withColumn("extra", (before + F.col("size") / 2 <= F.col("rest")).cast("bigint"))
    rest = placed.where(~inside).withColumn("extra", (F.coalesce(early, F.lit(False)) | F.col("certain")).cast("bigint"))
    return edge.unionByName(rest).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS number
  FROM documents),
w AS (SELECT *, length(bin(size + 1))::BIGINT AS weight FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM w GROUP BY source),
t AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
         coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
  FROM s),
c AS (SELECT *, (3 * total - 4 * before) * weight >= 4 * source_size * rest AS capped FROM t),
h AS (
  SELECT *, sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER ()::BIGINT AS held,
         sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()::BIGINT AS free FROM c),
g AS (
  SELECT source, source_size,
         CASE WHEN capped THEN source_size * 2.0::DOUBLE ELSE ((3 * total - 4 * held) * weight)::DOUBLE / (2 * free)::DOUBLE END AS target FROM h),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
m AS (SELECT w.source, w.weight, sum(w.size)::BIGINT AS words, any_value(target - whole * source_size) AS want
      FROM w JOIN k ON w.source IS NOT DISTINCT FROM k.source GROUP BY ALL),
n AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS greater,
         sum(words * weight) OVER (PARTITION BY source ORDER BY weight ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM m),
e AS (SELECT *, want > greater AND (want - greater) * weight >= upto AND words > 0 AS is_sure FROM n),
f AS (
  SELECT source, min(CASE WHEN is_sure THEN weight END) AS sure, max(want) - coalesce(sum(CASE WHEN is_sure THEN words END), 0)::BIGINT AS rest,
         coalesce(sum(CASE WHEN NOT is_sure THEN words * weight END), 0)::BIGINT AS weighted FROM e GROUP BY source),
r AS (
  SELECT w.doc_id, w.size, w.weight, w.number, k.source, source_size, target, whole, weighted, rest, coalesce(w.weight >= f.sure, false) AS certain
  FROM w JOIN k ON w.source IS NOT DISTINCT FROM k.source JOIN f ON w.source IS NOT DISTINCT FROM f.source),
p AS (SELECT *, rest * weight / weighted AS chance, (number + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM r),
q AS (SELECT *, CASE WHEN rest > 0 AND NOT certain THEN 1 - 1 / (1 + (u / (1 - u)) * ((1 - chance) / chance)) END AS rank FROM p),
o AS (
  SELECT *, coalesce(sum(CASE WHEN certain THEN 0 ELSE size END) OVER (PARTITION BY source, certain ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (whole + CASE WHEN certain OR rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
