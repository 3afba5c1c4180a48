"""Hostile texts, columns with reserved names, skewed ids, and sets that few keys stand for."""

import hashlib
import random
import time

import numpy as np
import pytest

from graphloom.llm import _edit, _linkage, decontaminate, line_dedup, ngram_join, pii_scan, secret_scan, source_mix, syncmers, toxicity

N = 1_000_000
HOSTILE = [
    "a [at] b" + ".c" * (N // 2), "a [at] " * (N // 7), "x" * N + "[at]", "eyJ" * (N // 3), "eyJaaaaaaaaaa." * (N // 14), "a.b@" * (N // 4), "1." * (N // 2), "+1" + "(" * N,
    "secret" + " " * N, "secret=" * (N // 7), "AKIA" * (N // 4), "0" * N, "1 " * (N // 2), "-----BEGIN " * (N // 11), "(555) 555 " * (N // 10), "@" * N, "sk-" * (N // 3),
]


@pytest.mark.parametrize("scan", [pii_scan.scan, secret_scan.scan])
def test_hostile_texts_end(spark, scan):
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(HOSTILE)], "doc_id long, text string, lang string, source string").repartition(4)
    began = time.time()
    assert len(scan(df).collect()) == len(HOSTILE)
    assert time.time() - began < 120


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, toxicity double, _text_key long, text_key long, _doc long, _key long, _gone string, gone string, _left string, left string, row long, id long"


def test_columns_of_any_name_stay(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(30)) for _ in range(40)) for _ in range(12)]
    rows = [(i, t + "\none line that all of these texts have in common", "en", "s", 1, 0.123, 0.25, 7, 8, 9, 10, "g", "h", "l", "m", 11, 12) for i, t in enumerate(texts + texts[:2])]
    df = spark.createDataFrame(rows, CLASH)
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, texts[3])], "item_id long, text string")
    given = {x["doc_id"]: x for x in df.collect()}
    for out in (toxicity.clean(df, labels), line_dedup.dedup(df), ngram_join.keep_one(df), decontaminate.clean(df, bench)):
        assert out.columns == df.columns
        for x in out.collect():
            assert all(x[c] == given[x["doc_id"]][c] for c in df.columns if c not in ("text", "n_chars"))
    assert {x["doc_id"] for x in ngram_join.keep_one(df).collect()} == set(range(12))
    assert 3 not in {x["doc_id"] for x in decontaminate.clean(df, bench).collect()}


def test_sets_with_few_filled_parts_share_a_key():
    r = np.random.default_rng(5)
    # All shingles in a few parts of the range of hashes.
    for n in (120, 300, 900):
        a = np.unique((r.integers(0, 4, n, dtype=np.uint64) << np.uint64(61)) | r.integers(0, 1 << 40, n, dtype=np.uint64))
        drop = len(a) // 10
        b = np.unique(np.concatenate((a[drop:], (np.uint64(1) << np.uint64(62)) | r.integers(0, 1 << 40, drop, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        assert 100 * both >= 80 * (len(a) + len(b) - both)
        assert len(np.intersect1d(ngram_join.tile_keys(a), ngram_join.tile_keys(b)))


def test_many_documents_of_one_id_or_none(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, " ".join(word() for _ in range(r.randint(0, 14)))) for i in range(1500)]
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = {}
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        h = len(t) // 2
        want.setdefault((d, t), set()).add(t[: len(t) - h] + nxt[:h])
    hashes = {hashlib.sha256(e.encode()).hexdigest() for es in want.values() for e in es}
    got = syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows) and {x["edited_sha256"] for x in got} == hashes


def test_likeness_is_the_jaccard_index_of_all_anchors(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(400)}" for _ in range(900)]
    changed = words[:600] + [f"x{r.randrange(400)}" for _ in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, ""), (4, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for d, _, a in syncmers.anchors(df).collect():
        sets.setdefault(d, set()).add(a)
    got = {x["doc_id"]: x for x in syncmers.fingerprints(df).collect()}
    assert len(sets[1]) > 64 * 2
    near = len(sets[1] & sets[2]) / len(sets[1] | sets[2])
    assert got[2]["near_next"] == pytest.approx(near) and 0.3 < near < 0.7
    assert len(got[1]["fingerprint"]) == 12 * len(got[1]["positions"]) and got[1]["positions"] == sorted(got[1]["positions"])
    assert got[3]["fingerprint"] == "" and len(got[4]["fingerprint"]) == 12


def test_questions_with_other_values_are_found(spark):
    r = random.Random(3)
    names = ["Mary", "John Smith", "Peter", "Ana Maria Lopez", "Łukasz", "Zoë"]
    shapes = [
        "{a} has {x} apples and gives {y} kg of them to {b} before walking home with what is left over",
        "When {a} drives {x} miles in {y} hours, how fast does {b} have to drive to arrive at the same time",
        "{a} and {b} share {x} euros so that one of them gets {y} euros more than the other one does",
    ]
    numbers = ["12", "7", "three", "twenty-four", "1,500", "9"]

    def filled(shape):
        a, b = r.sample(names, 2)
        x, y = r.sample(numbers, 2)
        return shape.format(a=a, b=b, x=x, y=y)

    items = [(i, filled(s)) for i, s in enumerate(shapes)] + [(10, "What is the capital of France?"), (11, "12 + 30 = ?")]
    docs = [(100 * i + k, filled(s)) for i, s in enumerate(shapes) for k in range(20)] + [(900, "He asked:\nwhat is the capital of France\nand left."), (901, "12 + 30 =?"), (902, "The capital of France is what we saw.")]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]) for x in found.collect()}
    wanted = {(100 * i + k, i) for i in range(3) for k in range(20)}
    assert len(got & wanted) >= 0.9 * len(wanted)
    assert got - wanted == {(900, 10), (901, 11)}


def test_spans_of_hidden_personal_data_are_recalled(spark):
    r = random.Random(7)
    digits = lambda n: "".join(r.choice("23456789") for _ in range(n))
    shown = [(i, f"call me on +1 {digits(3)}-{digits(3)}-{digits(4)} please") for i in range(400)]
    hidden = [(1000 + i, f"call me on {digits(3)}-{digits(3)}-{digits(4)} please") for i in range(30)]
    clean = [(2000 + i, f"page {digits(8)} of the total, version {digits(2)}.{digits(2)}") for i in range(400)]
    got = {x["doc_id"]: x["n_likely"] for x in pii_scan.scan(spark.createDataFrame(shown + hidden + clean, "doc_id long, text string")).collect()}
    assert sum(got[d] > 0 for d, _ in hidden) >= 27 and sum(got[d] > 0 for d, _ in clean) <= 20


def test_repositories_decide_beside_owners(spark):
    value = "own7secret3value9q8w7e"
    rows = [(i, f"token = {value}", "s1", f"l{i}") for i in range(secret_scan.LIVE_REPOSITORIES + 1)] + [(50, "token = another7secret3value9q8w", "s1", "l0")]
    rows += [(60 + i, "ghp_two0owners0many0repos0", f"t{i % 2}", f"l{i}") for i in range(secret_scan.EXAMPLE_REPOSITORIES)]
    got = {x["doc_id"]: x for x in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got[0]["n_live"] == 0 and got[0]["n_example"] == 0 and got[50]["n_live"] == 1
    assert got[60]["n_example"] == 1 and got[60]["spans"] == ""


def test_label_model_sees_correlated_voters():
    r = np.random.default_rng(2)
    y = r.random(4000) < 0.3
    vote = lambda right: np.where(r.random(4000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    one = vote(0.7)
    votes = np.stack([vote(0.85), vote(0.8), one, np.where(r.random(4000) < 0.95, one, -one), np.where(r.random(4000) < 0.95, one, -one)], axis=1)
    model = toxicity.LabelModel(votes, np.where(votes[:, 0] == 1, 0.8, 0.1))
    assert (2, 3) in {tuple(sorted((j, p))) for j, p in enumerate(model.parent) if p >= 0} or (2, 4) in {tuple(sorted((j, p))) for j, p in enumerate(model.parent) if p >= 0}
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.85


def test_certain_documents_are_taken_once(spark):
    rows = [(0, "w " * 4000, "a")] + [(i, "w", "a") for i in range(1, 200)] + [(1000 + i, "w " * 10, "b") for i in range(900)]
    got = {x["doc_id"]: x for x in source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    sums = sum(x["taken"] for d, x in got.items() if d < 1000)
    assert got[0]["taken"] % 4000 == 0 and abs(sums - got[0]["target"]) <= 4000


def test_tiles_settle_as_all_pairs_do():
    label = np.arange(6)
    assert _linkage._joined(label, np.array([0, 2, 4]), np.array([1, 3, 3])).tolist() == [0, 0, 2, 2, 2, 5]
    before = np.empty(3, dtype=object)
    before[:] = [[1, 5], [2], [5]]
    assert _linkage._first_met(before, np.array([0, 0, 1]), np.array([1, 2, 2])).tolist() == [True, False, True]


def test_far_pairs_are_given_up():
    r = random.Random(5)
    a, b, limit = [], [], []
    for _ in range(120):
        n = r.choice([50, 300, 900, 1500])
        x = [r.choice("abcdefgh ") for _ in range(n)]
        y = list(x)
        for _ in range(r.randint(0, n // 12)):
            i = r.randrange(len(y))
            y[i : i + r.randint(0, 2)] = r.choice(["", "q", "zz"])
        a.append(np.array([ord(c) for c in x], dtype=np.uint32))
        b.append(np.array([ord(c) for c in "".join(y)], dtype=np.uint32))
        limit.append(n // 20)
    assert _edit.within(a, b, np.array(limit)).tolist() == [_edit._wide(x, y, 10**9) <= t for x, y, t in zip(a, b, limit)]
