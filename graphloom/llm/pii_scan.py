"""Personal data by candidate gradient boosting, in native columns only.

High-recall generators propose spans: four strict kinds whose format proves them (the base),
and wide ones, numbers in any punctuation, telephone numbers without a country, and
spelled-out addresses.  A wide candidate that
overlaps a base span is a positive example and any other an unlabelled one; boosted trees
learn from format and context, without the marks that define the base kinds, which
candidates look like personal data.  They are fitted on a bounded sample of one half of the
distinct candidates; the score from which candidates are selected is calibrated for precision
by counts, in bins of the score, of the whole other half.  Base spans are always kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._boost import Boosted
from graphloom.llm._spans import joined, let, matches
from graphloom.plans.shared import materialize, release

#: Patterns that find what the plain forms find, without going back over long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"[(]?[0-9](?:[\x20().,:/-]{0,2}[0-9]){6,}+"
LOCAL = r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SPELLED = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\.)[A-Za-z0-9-]++)++"
SPELLED_MARK = r"[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
KINDS = ("email", "ip", "card", "phone", "number", "local", "spelled")
CONTEXT = 24
#: Candidates on which the trees are fitted: a bounded sample by hash.
SAMPLE = 4000
FEATURES = "array<int>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of payment cards."""
    each = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    worth = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _features(s: Column) -> Column:
    """Format and context, without plus signs and check digits, which define base kinds."""
    v, around = s["value"], F.lower(F.concat_ws(" ", s["before"], s["after"]))
    count = lambda chars: (F.char_length(v) - F.char_length(F.translate(v, chars, ""))).cast("int")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    groups = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
    return F.array(
        F.least(count("0123456789"), F.lit(40)), F.least(F.char_length(v), F.lit(80)), F.least(F.size(groups), F.lit(20)),
        F.least(F.char_length(F.get(groups, F.lit(0))), F.lit(20)), F.least(F.char_length(F.get(groups, F.size(groups) - 1)), F.lit(20)),
        F.least(F.coalesce(F.char_length(F.get(groups, F.lit(1))), F.lit(0)), F.lit(20)),
        count("()"), count("."), count("-"), count(" "), count(",:/"),
        F.size(F.array_distinct(F.regexp_extract_all(v, F.lit("[0-9]"), F.lit(0)))),
        flag(around.rlike("phone|tel|call|mobile|fax|contact")), flag(around.rlike("card|visa|payment|iban|account")),
        flag(around.rlike("ssn|passport|licen|social|birth|address|server|host")), flag(around.rlike("[$€£%]|page|version|isbn|total|year")),
        flag(F.right(s["before"], F.lit(1)).rlike("[A-Za-z0-9]")), flag(F.left(s["after"], F.lit(1)).rlike("[A-Za-z0-9]")),
        flag(v.contains("@") | v.rlike(SPELLED_MARK)), flag(v.rlike("^" + LOCAL + "$")),
    ).cast(FEATURES)


def base_spans(text: Column) -> Column:
    """``array<struct<rank, start, end, kind>>`` of the strict kinds, by kind, then start."""
    rules = {
        "email": (EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        "ip": (IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]{1,12}\.[0-9]")), lambda v: v.rlike(OCTETS)),
        "card": (CARD, F.rlike(text, F.lit(CARD)), lambda v: let(_digits(v), lambda d: F.char_length(d).between(13, 19) & luhn(d))),
        "phone": (PHONE, F.rlike(text, F.lit(r"\+[0-9]")), lambda v: F.char_length(_digits(v)).between(9, 15)),
    }

    def spans(kind: str) -> Column:
        pattern, when, valid = rules[kind]
        kept = F.filter(matches(text, pattern, when), lambda s: valid(s["value"]))
        return F.transform(kept, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*map(spans, rules)))


def wide_spans(text: Column) -> Column:
    """``array<struct<rank, start, end, kind, features, seen>>`` of the generators; ``seen`` hashes value and context."""

    def spans(kind: str, pattern: str, mark: str) -> Column:
        return F.transform(
            matches(text, pattern, F.rlike(text, F.lit(mark)), context=CONTEXT),
            lambda s: F.struct(F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), _features(s).alias("features"), F.xxhash64(s["value"], s["before"], s["after"]).alias("seen")),
        )

    return F.concat(spans("number", NUMBER, NUMBER), spans("local", LOCAL, LOCAL), spans("spelled", SPELLED, SPELLED_MARK))


def _candidates(docs: DataFrame, *extra: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *extra, base_spans(text).alias("base"), wide_spans(text).alias("wide"))
    touches = lambda w: F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    labelled = F.transform("wide", lambda w: w.withField("known", touches(w)))
    return found.withColumn("wide", F.when(F.size("wide") > 0, labelled).otherwise(F.array().cast("array<struct<rank:int,start:bigint,end:bigint,kind:string,features:array<int>,seen:bigint,known:boolean>>")))


def fit(candidates: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Trees fitted on at most ``sample`` distinct candidates, calibrated on all that are not of their half.

    Copies of a candidate and its context count once, so that no source or group of copies
    fills the sample.  Fewer than 20 candidates to fit on select nothing.
    """
    each = candidates.where(F.size("wide") > 0).select(F.explode("wide").alias("w"))
    each = materialize(each.groupBy(F.col("w.seen").alias("seen"), F.col("w.known").alias("y")).agg(F.first("w.features").alias("x")), "candidates")
    mine = F.pmod(F.xxhash64("seen"), F.lit(2)) == 0
    order = F.pmod(F.xxhash64("seen", F.lit(1)), F.lit(1 << 20))
    rows, n = each.where(mine), each.where(mine).count()
    # A hash under a bound first, so that no task sends many rows for the driver to choose from.
    if n > 4 * sample:
        rows = rows.where(order < F.lit(max(1, (2 * sample << 20) // n)))
    got = rows.orderBy(order, "seen", "y").limit(sample).select("x", "y").collect()
    model = Boosted(np.array([r["x"] for r in got], dtype=float), np.array([r["y"] for r in got], dtype=int))
    if model.trees:
        counts = each.where(~mine).groupBy(model.bin(F.col("x")).alias("bin")).agg(F.count("*").alias("n"), F.count_if("y").alias("right"))
        model.calibrate({r["bin"]: (r["n"], r["right"]) for r in counts.collect()})
    release(each)
    return model


def selected(docs: DataFrame, sample: int = SAMPLE, *extra: Column) -> DataFrame:
    """``doc_id``, the columns ``extra`` and the spans that are selected: ``base`` and, of those that touch none, ``likely``."""
    found = materialize(_candidates(docs, *extra), "personal")
    model = fit(found, sample)
    likely = F.filter("wide", lambda w: ~w["known"] & (model.column(w["features"]) >= F.lit(model.cut))) if model.trees and model.cut < float("inf") else F.filter("wide", lambda w: F.lit(False))
    plain = F.transform(likely, lambda w: F.struct(w["rank"].alias("rank"), w["start"].alias("start"), w["end"].alias("end"), w["kind"].alias("kind")))
    return found.withColumn("likely", F.array_sort(plain)).drop("wide")


def scan(docs: DataFrame, sample: int = SAMPLE, *extra: Column) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): its personal data.

    Columns: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_likely``.
    ``spans`` has base spans and, after them, the selected candidates that touch none.  Null
    texts count as empty; repeated rows and null doc_ids keep their rows; other columns are
    not read.
    """
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return selected(docs, sample, *extra).select(
        "doc_id", *(count(k) for k in KINDS[:4]),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "likely")).alias("spans"),
        F.size("likely").cast("bigint").alias("n_likely"),
    )


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, text)`` with the spans that ``scan`` selects replaced by ``[KIND]``.

    Spans that overlap are replaced together, by the kind of the first, of those the longest.
    """
    with_text = selected(docs, sample, F.col("doc_id").alias("_id"), F.col("text")).select(F.col("_id").alias("doc_id"), "text", F.concat("base", "likely").alias("spans"))
    ordered = F.array_sort(F.transform("spans", lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("back"), b["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(
            F.concat(acc["out"], F.expr("text").substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"),
            (-s["back"]).alias("at"),
        )
        longer = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], -s["back"]).alias("at"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(longer)

    done = F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.expr("text").substr((a["at"] + 1).cast("int"), F.lit(1 << 30))))
    return with_text.select("doc_id", F.when(F.size("spans") > 0, done).otherwise(F.col("text")).alias("text"))
