"""Graph operators on small tables."""

import pytest
from pyspark.sql import functions as F

from graphloom import schema as S
from graphloom.functions import paths as P
from graphloom.functions import text as X
from graphloom.operators import cluster, coupling, links, narrow, rank, traverse, vectors
from graphloom.operators.components import connected_components


def entity(path, ordinal, kind, name, **meta):
    return (path, ordinal, f"{path}#{kind}:{name}@{ordinal}", kind, name, 1, 2, {k: str(v) for k, v in meta.items()})


def entities(spark, *rows):
    return spark.createDataFrame([entity(*r[:4], **(r[4] if len(r) > 4 else {})) for r in rows], S.ENTITIES)


def docs(spark, **formats):
    return spark.createDataFrame([(p, f, 1, None, {}) for p, f in formats.items()], S.DOCUMENTS)


def doc_table(spark, rows):
    return spark.createDataFrame([(p, f, 1, None, {}) for p, f in rows], S.DOCUMENTS)


def pairs(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 7), (3, 10), (None, 4)] + [(20 + i, 21 + i) for i in range(30)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a int, b int")).collect()))
    assert {k: v for k, v in got.items() if k < 20} == {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 9: 9, 7: 7, 8: 7}
    assert {v for k, v in got.items() if k >= 20} == {20}


def test_path_functions(spark):
    df = spark.createDataFrame([("a/b/../c.x.go",), ("./q",), ("/r/../../s",), ("t",), ("../u/v",)], "p string")
    assert [r[0] for r in df.select(P.clean(F.col("p"))).collect()] == ["a/c.x.go", "q", "/s", "t", "../u/v"]
    assert [r[0] for r in df.select(P.extension(F.col("p"))).collect()] == [".go", "", "", "", ""]
    assert [r[0] for r in df.select(P.dir_name(F.col("p"))).collect()] == ["a/b/..", ".", "/r/../..", ".", "../u"]
    one = df.limit(1)
    assert one.select(P.snake_case(F.lit("HTTPServer")), P.owner(F.lit("a#b#c"))).first()[:] == ("h_t_t_p_server", "a")
    ok = lambda path, *pats: one.select(P.excluded(F.lit(path), list(pats))).first()[0]
    assert ok("a/b/c.go", "a/b") and ok("a/b/c.go", "*.go") and not ok("a/b/c.go", "a/*.go") and ok("a/c.go", "a/*.go") and not ok("ab/c", "a")


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(X.truncate_chars(F.lit("abcdef"), F.lit(n))) for n in (0, 1, 3, 6)] == ["", "a", "ab…", "abcdef"]
    assert [get(X.truncate_bytes(F.lit("aéz"), n)) for n in (1, 2, 3, 4)] == ["a", "a", "aé", "aéz"]
    assert get(X.line_slice(F.lit("a\nb\nc"), F.lit(2), F.lit(9))) == "b\nc"
    assert get(X.hits(F.lit("aaaa b aa"), F.lit("aa"))) == 3
    assert get(X.preview(F.array(*map(F.lit, "abcd")), 3)) == "`a`, `b`, `c`, …"
    assert one.select(*X.line_range(F.lit("3"), F.lit("1"))).first()[:] == (3, 3) and one.select(*X.line_range(F.lit("x"), F.lit("1"))).first()[:] == (0, 0)


def test_implements_and_documents(spark):
    e = entities(spark, ("a.go", 0, "struct", "GraphBuilder"), ("a.go", 1, "struct", "Runner"), ("b.go", 0, "interface", "Builder"), ("b.go", 1, "interface", "Walk"))
    assert pairs(links.implements(e), "source_id", "target_id", "weight") == {("a.go#struct:GraphBuilder@0", "b.go#interface:Builder@0", 0.8)}
    d = doc_table(spark, [("docs/graphBUILDER.md", "markdown"), ("walk.go", "golang")])
    assert pairs(links.documented_by_path(d, e), "source_id", "target_id") == {("docs/graphBUILDER.md", "a.go#struct:GraphBuilder@0"), ("docs/graphBUILDER.md", "b.go#interface:Builder@0")}


def test_package_imports(spark):
    d = doc_table(spark, [("/p/internal/ir/t.go", "golang"), ("/p/cmd/m.go", "golang")])
    e = entities(spark, ("/p/internal/ir/t.go", 0, "package", "ir"), ("/p/cmd/m.go", 0, "package", "main"), ("/p/cmd/m.go", 1, "import", "github.com/o/p/internal/ir"), ("/p/cmd/m.go", 2, "import", "fmt"))
    members = links.package_of(d, e)
    assert pairs(members, "path", "pkg_key") == {("/p/internal/ir/t.go", "/p/internal/ir"), ("/p/cmd/m.go", "/p/cmd")}
    assert pairs(links.package_imports(e, members), "source_id", "target_id") == {("/p/cmd/m.go", "package:/p/internal/ir")}


@pytest.mark.parametrize(
    ("source", "fmt", "name", "meta", "want"),
    [
        ("web/a.ts", "typescript", "./b", {}, ("web/b.ts", "exact")),
        ("web/a.ts", "typescript", "../lib", {}, ("lib/index.js", "exact")),
        ("web/a.ts", "typescript", "@/util/x", {}, ("src/util/x.ts", "suffix_match")),
        ("web/a.ts", "typescript", "react", {}, None),
        ("k/C.kt", "kotlin", "com.acme.Repo", {}, ("src/com/acme/Repo.kt", "suffix_match")),
        ("c/m.c", "c", "h.h", {"include_kind": "local"}, ("c/h.h", "exact")),
        ("c/m.c", "c", "deep/z.h", {"include_kind": "local"}, ("inc/deep/z.h", "suffix_match")),
        ("c/m.c", "c", "stdio.h", {"include_kind": "system"}, None),
        ("r/main.rs", "rust", "crate::shapes::Circle", {}, ("r/shapes.rs", "suffix_match")),
        ("e/a.ex", "elixir", "Geometry.Shapes", {}, ("lib/geometry/shapes.ex", "suffix_match")),
        ("web/b.ts", "typescript", "./b", {}, None),
    ],
)
def test_file_imports(spark, source, fmt, name, meta, want):
    rows = [("web/a.ts", "typescript"), ("web/b.ts", "typescript"), ("lib/index.js", "javascript"), ("src/util/x.ts", "typescript"), ("src/com/acme/Repo.kt", "kotlin"), ("k/C.kt", "kotlin")]
    rows += [("c/m.c", "c"), ("c/h.h", "c"), ("inc/deep/z.h", "c"), ("r/main.rs", "rust"), ("r/shapes.rs", "rust"), ("lib/geometry/shapes.ex", "elixir"), ("e/a.ex", "elixir")]
    got = links.file_imports(doc_table(spark, rows), entities(spark, (source, 0, "import", name, meta)))
    assert [(r["target_id"], r["metadata"]["resolution"]) for r in got.collect()] == ([want] if want else [])


def test_references(spark):
    e = entities(
        spark, ("a.kt", 0, "class", "Repo"), ("b.kt", 0, "class", "Repo"), ("c.kt", 0, "class", "Only"), ("d.kt", 0, "class", "geo.Circle"),
        ("x.kt", 0, "reference", "Repo"), ("y.kt", 0, "reference", "Repo"), ("x.kt", 1, "reference", "Only"), ("x.kt", 2, "reference", "Circle"), ("c.kt", 1, "reference", "Only"),
    )
    imported = spark.createDataFrame([("x.kt", "b.kt")], "doc_path string, target string")
    assert pairs(links.references(e, imported), "source_id", "target_id") == {
        ("x.kt#reference:Repo@0", "b.kt#class:Repo@0"), ("x.kt#reference:Only@1", "c.kt#class:Only@0"), ("x.kt#reference:Circle@2", "d.kt#class:geo.Circle@0"),
    }


def test_cochange(spark):
    rows = [("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c3", "z")] + [("big", f"f{i}") for i in range(21)]
    assert pairs(links.cochange(spark.createDataFrame(rows, "commit string, path string")), "source_id", "target_id", "weight") == {("a", "b", 0.5)}


def star(spark):
    d = doc_table(spark, [(x, "golang") for x in ("hub", "l1", "l2", "l3", "l4", "alone")])
    l = spark.createDataFrame([("hub#x", f"l{i}", "calls", 1.0, "extracted", {}) for i in range(1, 5)] + [("hub", "alone", "calls", 0.4, "", {}), ("l1", "ghost", "calls", 1.0, "", {}), ("l1", "l2", "documents", 1.0, "", {})], S.LINKS)
    return d, l


def test_star_graph(spark):
    d, l = star(spark)
    edges = coupling.coupling_edges(l, d)
    deg = coupling.degrees(edges, d)
    ranks = rank.pagerank(edges)
    assert abs(sum(r["rank"] for r in ranks.collect()) - 1) < 1e-6
    m = rank.hubs(deg.join(ranks, F.col("path") == F.col("node"), "left").select("path", "degree", "weighted_degree", F.coalesce("rank", F.lit(0.0)).alias("pagerank")))
    got = {r["path"]: r for r in rank.ranked(m).collect()}
    assert (got["hub"]["degree"], got["hub"]["weighted_degree"], got["hub"]["is_hub"]) == (4, 40.0, True)
    assert got["l1"]["degree"] == 1 and got["alone"]["degree"] == 0 and sum(r["is_hub"] for r in got.values()) == 1


def test_communities(spark):
    two = [("d/a", "d/b", 10), ("d/c", "d/e", 10)]
    edges = spark.createDataFrame(two + [(b, a, w) for a, b, w in two], "a string, b string, w bigint")
    got = cluster.clusters(cluster.network_members(cluster.communities(edges)))
    assert pairs(got, "name", "size") == {("d", 2), ("d #2", 2)}
    assert pairs(cluster.communities(edges, cap=1), "path", "community") == pairs(cluster.communities(edges), "path", "community")


def test_traverse(spark):
    d, l = star(spark)
    start = traverse.entry_documents(d, "l1")
    assert pairs(traverse.reachable(start, l, d, 2), "path", "hop") == {("l1", 0), ("hub", 1), ("l2", 1), ("l3", 2), ("l4", 2)}
    assert pairs(traverse.reachable(start, l, d, 2, "extracted", ["l3"]), "path") == {("l1",), ("hub",), ("l2",), ("l4",)} and pairs(traverse.entry_documents(d, "zz"), "path") == set()


def test_vectors_and_budget(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "h1"), ("b", [0.0, 1.0], "h2"), ("c", [1.0, 1.0], "h3"), ("z", [0.0, 0.0], "h4")], "node_id string, embedding array<float>, payload_hash string")
    assert [r["node_id"] for r in vectors.top_k(v, [1.0, 0.0], 2).collect()] == ["a", "c"]
    p = spark.createDataFrame([("a", "x", "h1"), ("b", "y", "changed"), ("n", "w", "new")], "node_id string, payload string, payload_hash string")
    assert vectors.upkeep_counts(v, p).first()[:] == (1, 2, 2)
    kept = vectors.upkeep(v, p, vectors.hashing_embedder(2))
    assert {(r["node_id"], r["payload_hash"]) for r in kept.collect()} == {("a", "h1"), ("b", "changed"), ("n", "new")}
    with pytest.raises(Exception, match="expected 3 dimensions"):
        vectors.check_dimensions(v, 3).collect()
    blocks = spark.createDataFrame([(1, "a" * 40), (2, "b" * 40), (3, "c" * 40)], "n int, snippet string")
    assert [(r["n"], r["tokens"], len(r["snippet"])) for r in narrow.within_budget(blocks, 15, ["n"]).orderBy("n").collect()] == [(1, 10, 40), (2, 5, 20)]
    files = narrow.files_within_budget(blocks.withColumnRenamed("snippet", "content"), 15, ["n"]).orderBy("n").collect()
    assert [(r["n"], r["truncated"]) for r in files] == [(1, False), (2, True)]
