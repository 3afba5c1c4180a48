"""What once grew faster than the input, or with the driver's memory."""

import random

import numpy as np

from graphloom.llm import _linkage, _tokens, line_dedup, toxicity


def _windows(lines):
    return [np.unique(line_dedup._placed(lines, np.array([i]))[2]) for i in range(len(lines.id))]


def test_frequent_windows_are_no_keys_of_lines_that_have_enough_others():
    r = random.Random(2)
    common = "".join(r.choice("abcdefgh ") for _ in range(24)).replace(" ", "x")
    tail = lambda n: "".join(r.choice("ijklmnop") for _ in range(n))
    lines = line_dedup.Lines([tail(90) + common + tail(90) for _ in range(200)])
    each = _windows(lines)
    frequent = np.unique(np.concatenate(each), return_counts=True)
    frequent = frequent[0][frequent[1] >= 3]
    assert 13 <= len(frequent) < 200
    keys = np.concatenate(list(line_dedup.window_keys(lines, np.arange(200), frequent)))
    assert np.unique(keys["key"], return_counts=True)[1].max() <= 2
    assert np.unique(np.concatenate(list(line_dedup.window_keys(lines, np.arange(200))))["key"], return_counts=True)[1].max() > 10


def test_linked_lines_share_two_keys_whatever_is_frequent():
    r = random.Random(13)
    texts = []
    for k in range(1500):  # edits as evenly spread as can be, in lines of which any share is frequent
        n = r.choice([80, 99, 100, 119, 120, 200, 299, 300, 500])
        s = "." + ("".join(r.choice("abcdefgh ") for _ in range(7 if k % 10 == 0 else n)) * n)[: n - 2] + "."
        t, most = list(s), n // 20
        for j in range(most):
            i = (2 * j + 1) * n // (2 * most)
            t[i] = "#" if k % 3 else "#" + t[i] if k % 2 else ""
        texts += [s, "".join(t)]
    lines = line_dedup.Lines(texts)
    shares = np.random.default_rng(1).choice([0.0, 0.05, 0.2, 0.3, 0.35, 0.4, 0.5, 0.9, 1.0], len(texts) // 2)
    each = _windows(lines)
    # The first windows by hash of content, of one line of a pair and then of the other.
    chosen = []
    for i, share in enumerate(shares):
        w = each[2 * i + i % 2]
        mixed = _tokens.mix(w + np.uint64(7))
        chosen.append(w[mixed <= np.quantile(mixed, share)] if share else w[:0])
    frequent = np.unique(np.concatenate(chosen))
    keys = np.concatenate(list(line_dedup.window_keys(lines, np.arange(len(texts)), frequent)))
    of = {}
    for key, x in zip(keys["key"].tolist(), keys["id"].tolist()):
        of.setdefault(x, set()).add(key)
    ids = lines.id.tolist()
    linked = [i for i in range(0, len(texts), 2) if len(texts[i]) // 20 <= min(len(texts[i]), len(texts[i + 1])) // 20]  # not if edits have made it too short for so many
    assert len(linked) > 1000
    assert all(len(of[ids[i]] & of[ids[i + 1]]) >= 2 for i in linked)


def test_frequent_windows_are_those_of_some_documents(spark):
    r = random.Random(4)
    tail = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    common = tail(12)
    docs = [(i, i, tail(80) + (common if i < 5 else "") + tail(40)) for i in range(50)] + [(60, 60, None), (61, 61, "\n".join(["x" * 100, "x" * 99 + "y"]))]
    got = line_dedup.frequent_windows(spark.createDataFrame(docs, "doc_id long, text_key long, text string"))
    lines = line_dedup.Lines([common + tail(70)])
    assert _windows(lines)[0].size > 1 and got.tolist() == [int(line_dedup._placed(lines, np.array([0]))[2][0])]
    assert not len(line_dedup.frequent_windows(spark.createDataFrame([], "doc_id long, text_key long, text string")))


def test_a_key_of_many_lines_that_are_not_near_is_paired_at_once():
    n = 300
    level, place = np.arange(n) % 40 * 3, 1 + np.arange(n) * 200
    e = _linkage.entries(np.full(n, 1 << 40, dtype=np.uint64), np.arange(1, n + 1), level.astype(np.uint8), place=place, half=True)
    packed = [p for _, _, p in _linkage._packed(_linkage.KEY, *(np.ascontiguousarray(e[c]) for c in ("key", "id", "tag")), 1)]
    got = {_linkage.PAIRS: [], _linkage.KEY: packed, _linkage.HEAD: []}
    kinds = np.concatenate([[_linkage.PAIRS], *(b.column("kind").to_numpy() for b in _linkage._bucket_rows(got, line_dedup.PAIRED, line_dedup.DENSE))])
    assert not (kinds == _linkage.MEMBER).any()


def test_the_driver_does_not_fit_the_classifier(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("on the driver")

    monkeypatch.setattr(toxicity, "_fit_linear", fail)
    docs = spark.createDataFrame([(i, "you idiot scum" if i % 2 else "a quiet day") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert len(toxicity.learn(docs, labels).marks)


def test_pairs_that_places_and_ends_part_are_no_candidates():
    """Linked lines have a window at near places, counted from both ends together."""
    length = np.array([408, 409, 425])
    level = line_dedup._levels(length)
    e = _linkage.entries(np.zeros(3, dtype=np.uint64), np.arange(3), level, place=np.array([1, 1, 20]), follows=length - 12 - np.array([0, 0, 19]))
    assert _linkage._near(e["tag"], e["tag"][[1, 2, 0]]).tolist() == [True, True, True]
    far = _linkage.entries(np.zeros(2, dtype=np.uint64), np.arange(2), level[:2], place=np.array([1, 16]), follows=np.array([396, 360]))
    assert not _linkage._near(far["tag"][:1], far["tag"][1:]).any()  # 15 before and 36 after are more than the edits allowed


def test_items_meet_only_by_keys_at_near_places():
    r = np.random.default_rng(5)
    for some in (0.0, 0.3):
        n, level = 40, np.full(40, 60)
        level[::3] = 61
        keys = [np.sort(r.choice(60, 8, replace=False)) for _ in range(n)]
        place = [r.integers(0, 60, 8) for _ in range(n)]
        probe = [r.random(8) < some for _ in range(n)]
        before, probed = np.empty(n, dtype=object), np.empty(n, dtype=object)
        before[:] = [(k << 16 | p) for k, p in zip(keys, place)]
        probed[:] = [x[y] for x, y in zip(before, probe)]
        a, b = np.triu_indices(n, 1)
        got = _linkage._first_met(before, a, b, probed, level)

        def met(i, j):
            reach = _linkage.SHIFT[max(level[i], level[j])]
            return any(k == m and not (s and t) and (p == 0 or q == 0 or abs(p - q) <= reach) for k, p, s in zip(keys[i], place[i], probe[i]) for m, q, t in zip(keys[j], place[j], probe[j]))

        want = [not met(i, j) for i, j in zip(a, b)]
        assert got.tolist() == want and any(want) and not all(want)


def test_a_large_key_is_parted_and_near_items_keep_a_part_in_common(spark):
    r = np.random.default_rng(9)
    n = 4 * _linkage.TILE
    level, key = r.integers(20, 80, n), int(_linkage.HALF) | 1 << 40
    length = (20 * 1.045 ** (level + 0.5)).astype(int)
    place = np.where(np.arange(n) % 50 == 0, 0, 1 + (r.random(n) * (length - 12)).astype(int))
    tag = level * 2 + 256 * place
    rows = [(key, i, int(t)) for i, t in enumerate(tag)] + [(1 << 30, i, int(t)) for i, t in enumerate(tag[:20])]
    got = _linkage._parted(spark.createDataFrame(rows, "key long, id long, tag int")).collect()
    of, size = {}, {}
    for x in got:
        if x["key"] != 1 << 30:
            of.setdefault(x["id"], set()).add(x["key"])
            size[x["key"]] = size.get(x["key"], 0) + 1
    assert max(size.values()) < _linkage.TILE and sum(x["key"] == 1 << 30 for x in got) == 20
    a, b = np.triu_indices(n, 1)
    near = _linkage._near(tag[a], tag[b])
    assert near.sum() > 1000 and all(of[i] & of[j] for i, j in zip(a[near].tolist(), b[near].tolist()))
    assert all(k & 0xFFFF == 0 for k in size)
