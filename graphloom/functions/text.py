"""Text functions: token estimates, truncation, line slices, keywords and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that a keyword query does not look for.
STOPWORDS = (
    "the and for are how what which when where who that this with from into onto than then them does dont cant have has was were been being "
    "also not but all any can you its it's our your their will would could should used use get"
).split()
FENCES = {"golang": "go", "javascript": "js", "typescript": "ts", "tsx": "tsx"}


def tokens(text: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.char_length(text) / 4).cast("bigint")


def truncate_chars(text: Column, n: Column) -> Column:
    """At most ``n`` code points, the last an ellipsis where something was cut and ``n`` is over one."""
    return (
        F.when(n <= 0, F.lit(""))
        .when(F.char_length(text) <= n, text)
        .when(n == 1, F.left(text, F.lit(1)))
        .otherwise(F.concat(F.left(text, (n - 1).cast("int")), F.lit("…")))
    )


def truncate_bytes(text: Column, n: int) -> Column:
    """At most ``n`` bytes of UTF-8, cut before a code point that does not fit."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(cut, "�+$", ""))


def payload_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_range(start: Column, end: Column) -> tuple[Column, Column]:
    """A start that is no positive number gives 0, 0; an end before the start becomes the start."""
    s, e = start.try_cast("int"), end.try_cast("int")
    ok = F.coalesce(s > 0, F.lit(False))
    return F.when(ok, s).otherwise(0), F.when(ok, F.greatest(s, F.coalesce(e, s))).otherwise(0)


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, counted from 1, cut to what the text has."""
    all_lines = lines(text)
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(all_lines))
    return F.when(first > last, F.lit("")).otherwise(F.array_join(F.slice(all_lines, first, F.greatest(last - first + 1, F.lit(0))), "\n"))


def keywords(query: Column) -> Column:
    """Identifiers of three characters or more without the stopwords, in lower case, each once."""
    found = F.regexp_extract_all(F.lower(query), F.lit("[a-z_][a-z0-9_]{2,}"), F.lit(0))
    return F.filter(F.array_distinct(found), lambda w: ~w.isin(*STOPWORDS))


def hits(text: Column, word: Column) -> Column:
    """How often ``word`` stands in ``text`` without overlap."""
    gone = F.replace(text, word, F.lit(""))
    return ((F.char_length(text) - F.char_length(gone)) / F.char_length(word)).cast("bigint")


def recall(answers: Column, found: Column) -> Column:
    return F.when(F.size(answers) == 0, F.lit(0.0)).otherwise(F.size(F.filter(answers, lambda a: F.array_contains(found, a))) / F.size(answers))


def reduction(used: Column, baseline: Column) -> Column:
    """How much less is read, as a share of the baseline; 0 without one."""
    return F.when(baseline > 0, 1 - used / baseline).otherwise(0.0)


def retrieval_summary(rows: DataFrame, column: str) -> DataFrame:
    """One row: ``mean_reduction, upper_median, n``; of an even number of values the median is the upper one."""
    return rows.agg(
        F.round(F.avg(column), 6).alias("mean_reduction"),
        F.round(F.expr(f"-percentile_disc(0.5) within group (order by -{column})"), 6).alias("upper_median"),
        F.count("*").alias("n"),
    )


def preview(members: Column, n: int) -> Column:
    """The first ``n`` members as code, and an ellipsis where there are more."""
    head = F.concat(F.lit("`"), F.array_join(F.slice(members, 1, n), "`, `"), F.lit("`"))
    return F.when(F.size(members) == 0, F.lit("none")).when(F.size(members) > n, F.concat(head, F.lit(", …"))).otherwise(head)


def fence(format_: Column) -> Column:
    """The name by which a code fence calls a format."""
    table = F.create_map(*[F.lit(x) for pair in FENCES.items() for x in pair])
    return F.coalesce(F.element_at(table, format_), format_)


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(text, "\n", 1))


def stamp(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def heading_level(line: Column) -> Column:
    return F.char_length(F.regexp_extract(line, r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1))
