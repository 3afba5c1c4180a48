"""Benchmark decontamination by template canonicalisation, in native columns only.

Numbers, names and units of a text are replaced by typed placeholders and what is left is
lower-cased and cut at anything that is not a letter or digit.  Windows of ``WINDOW`` tokens
of benchmark items are hash-joined with those of every document.  Where enough windows of
an item stand at one alignment in a document, the values behind the placeholders are
compared: the document repeats the item, with other values perhaps, if each value of the
item always became the same value and no two became one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._spans import let
from graphloom.plans.shared import materialize

WINDOW = 8
#: A window with fewer plain words says too little.
PLAIN_WORDS = 4
#: So many aligned windows (13 tokens in a row), or this share of an item's, make a leak.
RUN, SHARE = 6, 0.5
#: Windows whose copy to every executor is proven small.
BROADCAST_WINDOWS = 1 << 20
BROADCAST_TEXTS = 1 << 18
NUMBER_MARK, NAME_MARK, UNIT_MARK = "\ue001", "\ue002", "\ue003"
MARKS = (NUMBER_MARK, NAME_MARK, UNIT_MARK)
#: A run of capitalised words, those at the start of a sentence among them, is one name.
NAME = r"(?<!\p{L})\p{Lu}\p{Ll}++(?!\p{L})(?:\x20\p{Lu}\p{Ll}++(?!\p{L}))*+"
# Numbers written as words.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
_SPELLED = "(?:" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + r")(?!\p{L})"
NUMBER = rf"[0-9](?<![A-Za-z0-9À-ÿ][0-9])[0-9]*+(?:[.,:/][0-9]++)*+%?|(?<!\p{{L}}){_SPELLED}(?:[\x20-]{_SPELLED})*+"
UNIT = (
    "(" + NUMBER_MARK + r")\x20{0,3}(kg|g|mg|lb|lbs|oz|km|cm|mm|m|mi|miles|mile|feet|foot|ft|inches|inch|meters|metres|kilometers|grams|kilograms|pounds|"
    r"liters|litres|ml|l|gallons|hours|hour|minutes|minute|seconds|second|days|day|weeks|months|years|dollars|cents|euros|percent|degrees|kmh|mph|watts|volts)(?![A-Za-z])"
)
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_VALUES = "struct<numbers:array<string>,names:array<string>,units:array<string>>"


def _named(text: Column) -> Column:
    return F.regexp_replace(text, NAME, f" {NAME_MARK} ")


def _numbered(named: Column) -> Column:
    return F.regexp_replace(named, NUMBER, f" {NUMBER_MARK} ")


def tokens(text: Column) -> Column:
    """The template of a text: lower-cased words, and placeholders."""

    def cut(numbered: Column) -> Column:
        template = F.when(F.contains(numbered, F.lit(NUMBER_MARK)), F.regexp_replace(numbered, UNIT, f"$1 {UNIT_MARK} ")).otherwise(numbered)
        return F.filter(F.split(F.lower(template), _BREAK, -1), lambda w: w != "")

    return let(_numbered(_named(F.coalesce(text, F.lit("")))), cut)


def values(text: Column) -> Column:
    """What stood behind the placeholders, by type, in the order of the text."""

    def of(s: Column) -> Column:
        all_of = lambda t, p, g=0: F.regexp_extract_all(t, F.lit(p), F.lit(g))
        return F.struct(all_of(s["named"], NUMBER).alias("numbers"), all_of(s["text"], NAME).alias("names"), all_of(s["numbered"], UNIT, 2).alias("units"))

    named = _named(F.coalesce(text, F.lit("")))
    return let(F.struct(F.coalesce(text, F.lit("")).alias("text"), named.alias("named"), _numbered(named).alias("numbered")), of)


def windows(words: Column) -> Column:
    """Hashes of all windows, by place; a text of fewer tokens has none."""

    def of(w: Column) -> Column:
        return F.when(
            F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
        ).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def _plain(text: Column) -> Column:
    """The hash of a text's lower-cased words; null without words."""
    words = F.filter(F.split(F.lower(text), _BREAK, -1), lambda w: w != "")
    return let(words, lambda w: F.when(F.size(w) > 0, F.xxhash64(w)))


def _whole(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents of which the whole text or a line has the words of an item (item_id, plain)."""
    each = F.array_append(F.transform(F.split("text", "\n", -1), _plain), _plain(F.col("text")))
    found = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key(), F.explode(F.array_distinct(each)).alias("plain"))
    found = found.join(F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items, "plain").select("doc_id", "text_key", "item_id").distinct()
    return found.select("doc_id", "text_key", "item_id", F.lit(0).cast("bigint").alias("n_windows"), F.lit(0).cast("bigint").alias("item_windows"), F.lit(False).alias("changed"))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def _slots(words: Column, held: Column, start: Column, length: Column) -> Column:
    """For each placeholder from ``start`` on: its offset, type and lower-cased value."""
    kinds = dict(zip(MARKS, ("numbers", "names", "units")))

    def one(i: Column) -> Column:
        word = F.get(words, start + i)
        before = F.slice(words, F.lit(1), start + i)
        value = F.lit(None).cast("string")
        for mark, kind in kinds.items():
            value = F.when(word == mark, F.lower(F.get(held[kind], F.size(F.filter(before, lambda w: w == mark))))).otherwise(value)  # noqa: B023
        return F.struct(i.alias("at"), word.alias("type"), value.alias("value"))

    return F.filter(F.transform(F.sequence(F.lit(0), length - 1), one), lambda s: s["type"].isin(*MARKS))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents (doc_id, text) that repeat benchmark items (item_id, text), one row for each such pair.

    Columns ``doc_id, text_key, item_id, n_windows, item_windows, changed``: the aligned
    windows found, those the item has, and whether a value differs.  Repeated rows give
    their rows once.  An item without a usable window, of fewer than ``WINDOW`` tokens or of
    few plain words, is found where a whole text or line has its words (0 windows).  Texts
    without words match nothing.  Other columns are not read.
    """
    items = benchmark.select("item_id", "text").withColumn("words", tokens(F.col("text"))).withColumn("values", values(F.col("text")))
    items = materialize(items.where(F.size("words") >= WINDOW).select("item_id", "words", "values").distinct(), "items")
    each = items.select("item_id", "words", F.size("words").alias("length"), F.posexplode(windows(F.col("words"))).alias("item_at", "hash"))
    plain = F.size(F.filter(F.slice("words", F.col("item_at") + 1, F.lit(WINDOW)), lambda w: ~w.isin(*MARKS)))
    index = materialize(each.where(plain >= PLAIN_WORDS).select("hash", "item_id", "item_at"), "windows")
    rest = benchmark.select("item_id", _plain(F.col("text")).alias("plain")).where("plain is not null").distinct()
    rest = materialize(rest.join(index.select("item_id").distinct(), rest.item_id.eqNullSafe(index.item_id), "left_anti"), "unusable")
    sizes = index.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    known = F.broadcast(index) if index.count() <= BROADCAST_WINDOWS else index
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key(), F.posexplode(windows(tokens(F.col("text")))).alias("doc_at", "hash")).join(known, "hash")
    aligned = (
        found.groupBy("doc_id", "text_key", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift"))
        .agg(F.countDistinct("item_at").alias("n_windows"), F.min("item_at").alias("first"), F.max("item_at").alias("last"))
        .join(sizes, "item_id")
        .where((F.col("n_windows") >= RUN) | (F.col("n_windows") >= SHARE * F.col("item_windows")))
    )
    aligned = materialize(aligned, "aligned")
    keys = aligned.select("text_key").distinct()
    if aligned.count() <= BROADCAST_TEXTS:
        keys = F.broadcast(keys)
    texts = docs.select(_text_key(), "text").join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    texts = texts.select("text_key", tokens(F.col("text")).alias("doc_words"), values(F.col("text")).alias("doc_values"))
    both = aligned.join(texts, "text_key").join(items, "item_id")
    length = F.col("last") - F.col("first") + WINDOW
    pairs = F.zip_with(
        _slots(F.col("words"), F.col("values"), F.col("first"), length),
        _slots(F.col("doc_words"), F.col("doc_values"), F.col("first") + F.col("shift"), length),
        lambda a, b: F.struct(a["at"].alias("at"), b["at"].alias("doc_at"), F.concat(a["type"], F.coalesce(a["value"], F.lit(""))).alias("a"), F.concat(b["type"], F.coalesce(b["value"], F.lit(""))).alias("b")),
    )
    distinct = lambda *names: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(*(s[n].alias(n) for n in names)))))
    # Between matching windows the texts may differ: only slots that stand side by side are compared.
    judged = both.withColumn("slots", F.filter(pairs, lambda s: s["at"] == s["doc_at"])).select(
        "doc_id", "text_key", "item_id", "n_windows", "item_windows",
        ((distinct("a", "b") == distinct("a")) & (distinct("a", "b") == distinct("b"))).alias("consistent"),
        F.exists("slots", lambda s: s["a"] != s["b"]).alias("changed"),
    )
    best = judged.where("consistent").groupBy("doc_id", "text_key", "item_id")
    found = best.agg(F.max("n_windows").alias("n_windows"), F.first("item_windows").alias("item_windows"), F.min("changed").alias("changed"))
    return found if rest.isEmpty() else found.unionByName(_whole(docs, rest))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat a benchmark item; columns of any name stay."""
    bad = materialize(leaks(docs, benchmark).select("text_key").distinct(), "leaks")
    if bad.count() <= BROADCAST_TEXTS:
        bad = F.broadcast(bad)
    given = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), _text_key())
    return given.join(bad, "text_key", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
