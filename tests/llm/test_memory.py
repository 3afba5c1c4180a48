from graphloom.llm import _linkage, ngram_join


def test_executors_hand_memory_back_between_rounds(spark, monkeypatch):
    rounds, relieved = [], []
    dealt = _linkage._dealt
    monkeypatch.setattr(_linkage, "relieve", lambda s: relieved.append(len(rounds)), raising=False)
    monkeypatch.setattr(_linkage, "_dealt", lambda *a: rounds.append(1) or dealt(*a))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:50], f"x{i}", *words[50:]]) for i in range(30)]
    got = ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x["component_id"] for x in got.collect()} == {0}
    assert relieved[:2] == [0, 0]  # before and after the gathered pairs are verified
