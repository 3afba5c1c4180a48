"""Small cases in which an operator once did less than the whole job."""

import random

import numpy as np

from graphloom.llm import _edit, html_text, line_dedup, pii_scan


def near(a, b):
    x, y = (np.frombuffer(s.encode("utf-32-le"), dtype="<u4") for s in (a, b))
    return _edit._plain(x, y) <= min(len(a), len(b)) // 20


def test_long_lines_with_a_word_changed_are_duplicates(spark):
    r = random.Random(3)
    base = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(k)) for k in (12, 18, 20, 40, 90, 200)]
    lines = list(base)
    for s in base:
        i = len(s) // 2
        lines.append(s[:i] + "XYZ" + s[i + 3 :])
        most = len(s) // 20
        for n in (most, most + 1):  # spread as evenly as can be
            t = list(s)
            for j in range(n):
                t[(2 * j + 1) * len(s) // (2 * n)] = "#"
            lines.append("".join(t))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {(x["doc_id"], x["keep_doc_id"]) for x in line_dedup.line_classes(df).collect()}
    up = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if abs(len(lines[i]) - len(lines[j])) <= 20 and near(lines[i], lines[j]):
                lo, hi = sorted((up[i], up[j]))
                up = [lo if u == hi else u for u in up]
    assert got == {(i, u) for i, u in enumerate(up) if i != u} and len(got) >= 2 * len(base)


def test_distance_of_many_edits():
    r = random.Random(4)
    a, b, limit = [], [], []
    for _ in range(400):
        x = [r.choice("abc") for _ in range(r.randint(0, 90))]
        y = list(x)
        for _ in range(r.randint(0, 12)):
            i = r.randint(0, len(y))
            y[i : i + r.randint(0, 2)] = r.choice(["", "a", "bc"])
        a.append(np.array([ord(c) for c in x], dtype=np.uint32))
        b.append(np.array([ord(c) for c in "".join(y)], dtype=np.uint32))
        limit.append(r.randint(4, 12))
    assert _edit.within(a, b, np.array(limit)).tolist() == [_edit._plain(x, y) <= t for x, y, t in zip(a, b, limit)]


def test_short_lines_repeat_exactly(spark):
    rows = [(1, "Yes.\n\n  Yes.\t\nNo."), (2, "a long enough line to be joined\nNo!"), (3, "Yes.\n \nNo!"), (4, "No.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(x) for x in line_dedup.line_classes(df).drop("text_key").collect()}
    assert got == {(1, 2, 1, 0), (3, 0, 1, 0), (3, 2, 2, 1), (4, 0, 1, 3)}
    kept = {x["doc_id"]: x["text"] for x in line_dedup.dedup(df).collect()}
    assert kept == {1: "Yes.\n\nNo.", 2: rows[1][1]}


def test_redaction_takes_all_that_the_scan_selects(spark):
    r = random.Random(6)
    digits = lambda n: "".join(r.choice("23456789") for _ in range(n))
    rows = [(i, f"please call +1 {digits(3)} {digits(3)} {digits(4)} today") for i in range(150)]
    rows += [(1000 + i, f"please call {digits(3)} {digits(3)} {digits(4)} today") for i in range(20)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {x["doc_id"]: x["spans"] for x in pii_scan.scan(df).collect()}
    texts = {x["doc_id"]: x["text"] for x in pii_scan.redact(df).collect()}
    assert any(spans[1000 + i] for i in range(20))
    for d, text in rows:
        if not text:
            assert texts[d] == text
            continue
        hidden = {p for s in spans[d].split(",") if s for p in range(*map(int, s.split(":")[1:]))}
        left = "".join(c if p not in hidden else "\n" for p, c in enumerate(text))
        assert all(part in texts[d] for part in left.split("\n")) and sum(map(str.isdigit, texts[d])) == sum(map(str.isdigit, left))


def test_visible_text_of_pages_stays():
    for source, want in [
        ("<style>@media print{.n{display:none}} @media (max-width:600px){.w{display:none}} .z{display:none}</style><p class=n>a<p class=w>b<p class=z>c", "a\n\nb"),
        ("<style>@media screen and (min-width:600px){.n{display:none}}</style><p class=n>a<p>b", "b"),
        ("<style>.h{display:none}.h{display:block}.k{display:none}</style><p class=h>a<p class=k style='display:block'>b<p class=k>c", "a\n\nb"),
        ("<p title=it's>a</p><p title=it's>b</p>", "a\n\nb"),
        ('x<img alt="" tall">y<b id="z">w</b>', "xyw"),
    ]:
        assert html_text._Page(source).run() == want


def test_lines_of_large_keys_meet(spark):
    r = random.Random(11)
    tail = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for _ in range(4):  # lines of a length have the key of their prefix, and probe the one of shorter lines
        prefix = tail(15)
        for _ in range(60):
            rest = tail(15)
            rows += [prefix + x for x in (rest, rest[:9] + "#" + rest[10:], tail(14), tail(15))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(x["doc_id"], x["keep_doc_id"]) for x in line_dedup.line_classes(df).collect()}
    assert got == {(i, i - 1) for i in range(1, len(rows), 4)}


def test_linked_long_lines_share_a_key():
    r = random.Random(12)
    lines = []
    for k in range(1500):  # edits as evenly spread as can be, in lines that repeat themselves, too
        n = r.choice([80, 99, 100, 119, 120, 200, 299, 300, 500])
        s = ("".join(r.choice("abcdefgh ") for _ in range(7 if k % 10 == 0 else n)) * n)[: n - 2]
        s = "." + s + "."
        t, most = list(s), n // 20
        for j in range(most):
            i = (2 * j + 1) * n // (2 * most)
            t[i] = "#" if k % 3 else "#" + t[i]
        lines += [s, "".join(t)]
    found = line_dedup.Lines(lines)
    entries = np.concatenate(list(line_dedup.window_keys(found, np.arange(len(lines)))))
    keys = [set() for _ in lines]
    at = {x: i for i, x in enumerate(found.id.tolist())}
    for key, id_ in zip(entries["key"].tolist(), entries["id"].tolist()):
        keys[at[id_]].add(key)
    assert all(keys[i] & keys[i + 1] for i in range(0, len(lines), 2))
    assert max(map(len, keys)) < 100


def test_places_of_keys_part_lines_and_survive_packing():
    from graphloom.llm import _linkage

    n = 1000
    key, level, place = np.arange(n, dtype=np.uint64) << np.uint64(54), np.full(n, 60, dtype=np.uint8), np.arange(n) % 70
    e = _linkage.entries(key, np.arange(n), level, place=place)
    got = _linkage._unpacked([p for _, _, p in _linkage._packed(_linkage.KEY, *(np.ascontiguousarray(e[c]) for c in ("key", "id", "tag")), 7)])
    assert all((x == e[c][np.argsort(key)]).all() for x, c in zip(got, ("key", "id", "tag")))
    near = _linkage._near(e["tag"], np.full(n, e["tag"][1]))
    assert (near == ((place == 0) | (place - 1 <= _linkage.SHIFT[60]))).all() and not near.all()
    # A line of this level allows no more edits than that.
    assert line_dedup._levels(np.array([279]))[0] == 59 and 279 // 20 <= _linkage.SHIFT[59]
