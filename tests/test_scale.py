"""Operators whose rows once grew with the square of a group."""

from graphloom.operators import links


def test_references_by_groups_are_those_of_listed_documents(spark):
    entity = "doc_path string, ordinal int, entity_id string, type string, name string"
    declared = [(f"d{i}", 0, f"d{i}#c", "class", f"n{i % 3}") for i in range(12)] + [("d0", 1, "d0#e", "class", "n0"), ("x", 0, "x#c", "class", "only")]
    asked = [(f"d{i}", 5, f"d{i}#r", "reference", f"n{i % 3}") for i in range(12)] + [("c", i, f"c#{i}", "reference", n) for i, n in enumerate(["n0", "n1", "only", "none"])]
    entities = spark.createDataFrame(declared + asked, entity)
    groups = [(f"g{i % 4}", f"d{i}") for i in range(12)] + [("g0", "d1"), ("g0", "d1")]
    imported = [(f"d{i}", f"g{i % 4}") for i in range(12)] + [("c", "g1"), ("c", "g2"), ("c", "g2"), ("d3", None)]
    listed = spark.createDataFrame([(d, t) for d, g in imported for h, t in groups if g == h], "doc_path string, target string")
    pairs = lambda rows: sorted((x["source_id"], x["target_id"]) for x in rows.collect())
    want = pairs(links.references(entities, listed))
    got = links.references(entities, spark.createDataFrame(imported, "doc_path string, target string"), spark.createDataFrame(groups, "target string, at string"))
    assert pairs(got) == want and ("c#2", "x#c") in want and len(want) == 4
