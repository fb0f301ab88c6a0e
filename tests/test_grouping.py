"""Grouping, numbering, lookups, grids and joins."""

import random

from pyspark.sql import functions as F

from quirefold.operators import grids, grouping
from quirefold.operators.joins import as_of_join, overlap_join


def test_single_root(spark):
    rows = [("a", "Root/a.jpg", False), ("a", "Root/sub", True), ("a", "__MACOSX/x", False), ("b", "a.jpg", False), ("b", "Root/b.jpg", False), ("c", "A/1.jpg", False), ("c", "B/2.jpg", False), ("d", None, None), ("e", "R", True)]
    df = spark.createDataFrame(rows, "src string, path string, folder boolean")
    got = {r["src"]: r["root"] for r in grouping.single_root(df, "src", "path", "folder").collect()}
    assert got == {"a": "Root", "b": None, "c": None, "d": None, "e": "R"}


def test_runs_and_modes(spark):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(["A", "B", "B", "A", None, None])], "g int, k int, v string")
    assert [r["run"] for r in grouping.runs(df, ["g"], ["k"], "v").orderBy("k").collect()] == [0, 1, 1, 2, 3, 3]
    assert grouping.most_common(df, ["g"], "v", ["k"]).collect()[0].asDict() == {"g": 0, "v": "A", "n": 2}
    assert grouping.runs(df.limit(0), ["g"], ["k"], "v").collect() == []


def test_first_and_largest(spark):
    df = spark.createDataFrame([(0, 1, 5), (0, 2, 9), (0, 3, 9), (1, 4, None)], "g int, k int, s int")
    assert {(r.g, r.k) for r in grouping.largest_of(df, ["g"], "s", ["k"], ["k", "s"]).collect()} == {(0, 2), (1, 4)}
    assert {(r.g, r.k) for r in grouping.first_of(df, ["g"], ["k"], ["k"]).collect()} == {(0, 1), (1, 4)}


def test_natural_sorted(spark):
    df = spark.createDataFrame([("a", "x1"), ("a", "x2"), ("b", "x10"), ("b", "x2"), ("c", None)], "g string, n string")
    assert {r.g: r.natural for r in grouping.natural_sorted(df, ["g"], "n").collect()} == {"a": True, "b": False}


def test_lines_fusion_positions(spark):
    df = spark.createDataFrame([(0, k) for k in range(6)], "g int, line int")
    gone = spark.createDataFrame([(0, 1), (0, 4), (0, 4)], "g int, line int")
    assert [(r.line, r.kept_line) for r in grouping.keep_lines(df, gone, ["g"], "line").orderBy("line").collect()] == [(0, 0), (2, 1), (3, 2), (5, 3)]
    fused = grouping.fuse([spark.createDataFrame([("b",)], "name string"), spark.createDataFrame([("a",)], "name string")], "name")
    assert sorted(r.name for r in fused.collect()) == ["fusion_0001_b", "fusion_0002_a"]
    right = spark.createDataFrame([(0, "p"), (0, "q")], "g int, cover string")
    joined = grouping.positional_join(df, right, ["g"], ["line"], ["cover"]).orderBy("line").collect()
    assert [r.cover for r in joined] == ["p", "q", None, None, None, None]


def test_collisions(spark):
    df = spark.createDataFrame([("", "foo_bar", "foo-bar", 2), ("", "foo-bar", "foo-bar", 1), ("", "FOO BAR", "foo-bar", 3)], "g string, raw string, slug string, k int")
    assert [r.unique_slug for r in grouping.collision_names(df, ["g"], ["k"], "slug", "raw").orderBy("k").collect()] == ["foo-bar", "foo-barA", "foo-barAA"]


def merge_reference(boxes, dx, dy):
    boxes = list(boxes)
    j = 0
    while j + 1 < len(boxes):
        merged, other = None, []
        for c in boxes[j + 1 :]:
            f = boxes[j]
            if not (c[0] - dx > f[1] or c[1] + dx < f[0] or c[2] - dy > f[3] or c[3] + dy < f[2]):
                m = merged or f
                merged = (min(m[0], c[0]), max(m[1], c[1]), min(m[2], c[2]), max(m[3], c[3]))
            else:
                other.append(c)
        if merged:
            boxes, j = boxes[:j] + other + [merged], 0
        else:
            j += 1
    return boxes


def test_merge_boxes(spark):
    rng = random.Random(6)
    for _ in range(40):
        boxes = [(x, x + rng.randrange(8), y, y + rng.randrange(8)) for x, y in [(rng.randrange(40), rng.randrange(40)) for _ in range(8)]]
        assert grouping.merged_boxes(boxes, 1, 2) == merge_reference(boxes, 1, 2)
    df = spark.createDataFrame([(0, k, *b) for k, b in enumerate([(0, 4, 0, 0), (0, 4, 1, 1), (9, 9, 9, 9)])], "g int, k int, x1 long, x2 long, y1 long, y2 long")
    got = {tuple(r)[2:] for r in grouping.merge_boxes(df, ["g"], ["k"], 0, 1).collect()}
    assert got == {(0, 4, 0, 1), (9, 9, 9, 9)}


def test_histogram_trim(spark):
    rng = random.Random(8)
    counts = {b: rng.randrange(0, 20) for b in range(30)}
    df = spark.createDataFrame([(0, b, n) for b, n in counts.items() if n], "g int, bin int, n long")
    cut = int(sum(counts.values()) * 0.2)
    want = dict(counts)
    for order in (sorted(want), sorted(want, reverse=True)):
        left = cut
        for b in order:
            gone = min(left, want[b])
            want[b] -= gone
            left -= gone
    got = {r.bin: r.n for r in grids.trim_histogram(df, ["g"], 0.2).collect()}
    assert got == {b: n for b, n in want.items() if n}


def test_border_votes(spark):
    rng = random.Random(10)
    for h, w in ((3, 4), (5, 5), (7, 12), (11, 6)):
        black = [[rng.random() < 0.5 if rng.random() < 0.2 else y < 6 for x in range(w)] for y in range(h)]
        total = 0
        for n, other, cell in ((h, w, lambda a, b: black[a][b]), (w, h, lambda a, b: black[b][a])):
            for start in range(0, n, 5):
                a = max(0, n - 5) if start + 5 > n else start
                cells = [cell(i, j) for i in range(a, min(a + 5, n)) for j in range(other)]
                total += len(cells) if all(cells) else -len(cells) if not any(cells) else 0
        df = spark.createDataFrame([(0, y, x, black[y][x]) for y in range(h) for x in range(w)], "g int, y int, x int, b boolean")
        assert grids.border_votes(df, ["g"], F.col("b")).first()["total"] == total


def test_as_of_join(spark):
    left = spark.createDataFrame([("u", 5, "a"), ("u", 1, "b"), ("v", 9, "c"), (None, 9, "d"), ("u", None, "e")], "k string, t int, id string")
    right = spark.createDataFrame([("u", 2, 20), ("u", 5, 50), ("u", 7, 70), (None, 1, 10)], "k string, s int, x int")
    got = {r.id: r.x for r in as_of_join(left, right, ["k"], "t", "s", ["x"]).collect()}
    assert got == {"a": 50, "b": None, "c": None, "d": None, "e": None}


def test_overlap_join(spark):
    rng = random.Random(11)
    a = [(rng.randrange(3), i, s, s + rng.randrange(0, 30)) for i, s in enumerate(rng.randrange(100) for _ in range(60))]
    b = [(rng.randrange(3), i, s, s + rng.randrange(0, 30)) for i, s in enumerate(rng.randrange(100) for _ in range(60))]
    left = spark.createDataFrame(a, "g int, i int, start int, stop int")
    right = spark.createDataFrame(b, "g int, j int, start2 int, stop2 int")
    got = sorted((r.i, r.j) for r in overlap_join(left, right, ["g"], 8).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])
