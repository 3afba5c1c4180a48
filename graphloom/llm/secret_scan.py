"""Secret scan with corpus-wide ownership frequency, in native columns only.

Every text is searched once for three base kinds of secret and for wider candidates.  The
hash of a candidate is counted over the distinct repositories and owners in which it
stands: a value that many owners hold, or several owners in many repositories, is a copied
example; one that stands with a single owner, in few of its repositories, and looks random
is live.  Base spans are always reported; wider candidates are
added where ownership says that they are not copied examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._spans import joined, matches
from graphloom.plans.shared import materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Wider candidates: keys with a vendor's prefix, signed tokens, and headers of private keys.
VENDOR = r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_)[A-Za-z0-9_-]{16,}"
SIGNED = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
PEM = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"
KINDS = ("assign", "access", "hex", "vendor", "signed", "pem")
#: From so many owners on, or so many repositories of more than one owner, a value is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
#: In more repositories than this, a single owner's value is a shared default.
LIVE_REPOSITORIES = 4
#: Hashes whose copy to every executor is proven small.
BROADCAST_HASHES = 1 << 19


def _has(text: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def candidates(text: Column) -> Column:
    """``array<struct<start, rank, end, kind, base, value>>`` sorted by start, then kind."""
    low = F.lower(text)

    def kind(name: str, spans: Column, base: bool, inner: bool = False) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(KINDS.index(name)).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind"),
                F.lit(base).alias("base"), (s["inner"] if inner else s["value"]).alias("value"),
            ),
        )

    assign = F.filter(matches(text, ASSIGN, _has(low, "passw", "secret", "token", "api"), inner=2), lambda s: F.char_length(s["inner"]) >= 6)
    return F.array_sort(
        F.concat(
            kind("assign", assign, True, inner=True),
            kind("access", matches(text, ACCESS, _has(text, "AKIA")), True),
            kind("hex", matches(text, HEX, F.rlike(text, F.lit(HEX))), True),
            kind("vendor", matches(text, VENDOR, _has(text, "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "sk-", "k_live_")), False),
            kind("signed", matches(text, SIGNED, _has(text, "eyJ")), False),
            kind("pem", matches(text, PEM, _has(text, "PRIVATE KEY-----")), False),
        )
    )


def _random_looking(value: Column) -> Column:
    """Sixteen characters or more, digits among them, and at least nine different ones."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.char_length(value) >= 16) & value.rlike("[0-9]") & (distinct >= 9)


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source, lang): its secrets and their standing.

    Columns: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example,
    live_spans``.  Null texts count as empty and have no spans.  By default the owner is the
    row's source and the repository its source and language; nulls are an owner of their
    own.  Repeated rows and repeated or null doc_ids each keep their own row.  Columns of
    other names are not read.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("?")), F.col("lang")) if repository is None else repository
    found = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce(owner, F.lit("?")).alias("owner"),
            F.coalesce(repository, F.lit("?")).alias("repository"),
            F.transform(
                candidates(F.coalesce("text", F.lit(""))),
                lambda s: F.struct(
                    s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"),
                    F.xxhash64(s["value"], F.lit(5)).alias("hash"), _random_looking(s["value"]).alias("random"),
                ),
            ).alias("found"),
        ),
        "secrets",
    )
    each = found.where(F.size("found") > 0).select("row", "doc_id", "owner", "repository", F.explode("found").alias("s"))
    spread = (
        each.select(F.col("s.hash").alias("hash"), "owner", "repository").distinct()
        .groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
        .where("owners > 1 or repositories > 1")
    )
    spread = materialize(spread, "owners")
    if spread.count() <= BROADCAST_HASHES:
        spread = F.broadcast(spread)
    known = each.withColumn("hash", F.col("s.hash")).join(spread, "hash", "left")
    owners, repositories = (F.coalesce(c, F.lit(1)) for c in ("owners", "repositories"))
    judged = known.select(
        "row", "doc_id",
        F.struct(
            F.col("s.start").alias("start"), F.col("s.rank").alias("rank"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"),
            F.col("s.base").alias("base"),
            ((owners >= EXAMPLE_OWNERS) | ((owners > 1) & (repositories >= EXAMPLE_REPOSITORIES))).alias("example"),
            ((owners == 1) & (repositories <= LIVE_REPOSITORIES) & F.col("s.random")).alias("live"),
        ).alias("s"),
    )
    some = judged.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("s")).alias("s"))
    none = found.where(F.size("found") == 0).select("row", "doc_id", F.array().cast(some.schema["s"].dataType).alias("s"))
    base = F.filter("s", lambda x: x["base"])
    kept = F.filter("s", lambda x: x["base"] | ~x["example"])
    live = F.filter("s", lambda x: x["live"])
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return some.unionByName(none).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(kept).alias("spans"),
        F.size(live).cast("bigint").alias("n_live"),
        F.size(F.filter("s", lambda x: x["example"])).cast("bigint").alias("n_example"),
        joined(live).alias("live_spans"),
    )
