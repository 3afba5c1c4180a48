"""What operators leave behind or send on, which once outgrew memory, disk or the input."""

import os
import random

import numpy as np

from graphloom.llm import _linkage, line_dedup, syncmers
from graphloom.plans.shared import materialize, relieve


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    frame = spark.range(1000).repartition(3, "id")
    out = materialize(frame, "moved")
    for _ in range(50):  # they go beside what comes next
        if not (left := _shuffle_files(spark) - before):
            break
        spark.range(1).count()
    assert not left and out.count() == frame.count() == 1000


def test_executors_collect_their_garbage(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    relieve(spark)
    assert whole() > before


def test_a_key_of_many_near_copies_gives_few_pairs():
    n = 100
    key, level = np.full(n, 1 << 40, dtype=np.uint64), np.full(n, 30, dtype=np.uint8)
    e = _linkage.entries(key, np.arange(1, n + 1), level, place=np.ones(n, dtype=np.int64))
    packed = [p for _, _, p in _linkage._packed(_linkage.KEY, *(np.ascontiguousarray(e[c]) for c in ("key", "id", "tag")), 1)]
    got = {_linkage.PAIRS: [], _linkage.KEY: packed, _linkage.HEAD: []}
    kinds = np.concatenate([b.column("kind").to_numpy() for b in _linkage._bucket_rows(got, _linkage.PAIRED, line_dedup.DENSE)])
    assert (kinds == _linkage.PAIRS).sum() == n - 1 and (kinds == _linkage.MEMBER).sum() == n


def test_near_copies_and_strangers_of_one_key_are_told_apart(spark):
    r = random.Random(5)
    tail = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, shared = [], tail(30)
    for _ in range(6):  # each of them more than once so many lines that its keys are dense
        base = shared + tail(90)
        for i in range(20):
            p = 40 + 4 * i
            rows.append(base[:p] + "#" + base[p + 1 :])
    rows += [shared + tail(90) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(x["doc_id"], x["keep_doc_id"]) for x in line_dedup.line_classes(df).collect()}
    assert got == {(i, i // 20 * 20) for i in range(120) if i % 20}


def test_buckets_of_neighbours_are_a_short_expression_in_the_order_of_ids(spark):
    r = random.Random(9)
    ids = sorted(r.sample(range(-(10**6), 10**6), 2000))
    rows = spark.createDataFrame([(i, "t") for i in ids], "at long, text string")
    out = rows.select("at", syncmers._buckets(rows).alias("bucket"))
    got = [x["bucket"] for x in out.orderBy("at").collect()]
    assert got == sorted(got) and len(set(got)) > 16
    assert len(out._jdf.queryExecution().analyzed().toString()) < 10_000
