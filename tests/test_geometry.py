"""Sizes and splits against plain arithmetic."""

import math
import random

from pyspark.sql import functions as F

from quirefold.functions import geometry as G


def run(spark, expression, rows, names="w h fw fh"):
    names = names.split()
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} int" for n in names))
    return [r["v"] for r in df.select("k", expression(*[F.col(n) for n in names]).alias("v")).orderBy("k").collect()]


def half_up(x):
    return math.floor(x + 0.5)


def test_contain_and_fit(spark):
    rng = random.Random(3)
    rows = [tuple(rng.randrange(1, 3000) for _ in range(4)) for _ in range(300)]
    for (w, h, W, H), v, box in zip(rows, run(spark, G.contain_size, rows), run(spark, G.fit_box, rows)):
        if w / h > W / H:
            assert (v.width, v.height) == (W, max(1, half_up(h / w * W)))
        elif w / h < W / H:
            assert (v.width, v.height) == (max(1, half_up(w / h * H)), H)
        assert box.left + box.width <= w + 1 and box.top + box.height <= h + 1 and box.left >= 0 and box.top >= 0


def test_spreads(spark):
    rows = [(100, 150, 600, 800), (300, 200, 600, 800), (500, 200, 600, 800), (110, 100, 600, 800)]
    assert [[(p.order_class, p.width, p.height) for p in v] for v in run(spark, G.spread_parts, rows)] == [[("x", 100, 150)], [("b", 150, 200), ("c", 150, 200)], [("d", 200, 500)], [("x", 110, 100)]]
    both = run(spark, lambda *c: G.spread_parts(*c, splitter="both"), rows[1:2])
    assert [p.order_class for p in both[0]] == ["b", "c", "d"]
    rotated = run(spark, lambda *c: G.spread_parts(*c, splitter="rotate"), rows)
    assert [[p.order_class for p in v] for v in rotated] == [["x"], ["d"], ["d"], ["d"]]


def test_parts_cover_the_whole(spark):
    heights = [1, 5, 700, 1000, 1050, 1051, 1400, 1401, 2799, 5000, 70000]
    for h, v in zip(heights, run(spark, lambda h: G.overlap_parts(F.lit(0), h, 700), [(h,) for h in heights], "h")):
        assert v[0].top == 0 and v[-1].bottom == h
        # the step between views is rounded down, so the last one can miss a few rows
        assert all(a.bottom + len(v) >= b.top for a, b in zip(v, v[1:]))
    for h, v in zip(heights, run(spark, lambda h: G.halved_parts(F.lit(100), h, 50_000), [(h,) for h in heights], "h")):
        assert [p.top for p in v] == [sum(q.height for q in v[:k]) for k in range(len(v))]
        assert sum(p.height for p in v) == h and all(p.height * 100 < 50_000 for p in v)
    assert [p.height for p in run(spark, lambda h: G.halved_parts(F.lit(800), h, 1_000_000), [(4000,)], "h")[0]] == [1000] * 4
    assert [(p.half, p.top, p.height) for p in run(spark, G.tall_parts, [(2000,)], "h")[0]] == [("above", 0, 1920), ("below", 1920, 80)]


def test_limits_and_boxes(spark):
    (a,) = run(spark, lambda w, h: G.limit_pixels(w, h, 100), [(100, 400)], "w h")
    assert (a.width, a.height) == (5, 20)
    (b,) = run(spark, lambda w, h: G.limit_width(w, h, 50), [(100, 401)], "w h")
    assert (b.width, b.height) == (50, 201)
    (c,) = run(spark, lambda w, h: G.clamp_box(F.lit(50), F.lit(3), w - 4, h - 90, w, h), [(200, 300)], "w h")
    assert (c.left, c.top, c.right, c.bottom) == (20, 3, 196, 270)
    assert [v is None for v in run(spark, lambda w, h: G.cover_box(w, h), [(100, 100), (101, 100)], "w h")] == [True, False]
    (d,) = run(spark, lambda w, h: G.kept_span(w, h, 0.5), [(3, 10)], "w h")
    assert (d.first, d.last) == (4, 8)
    assert run(spark, G.view_height, [(800, 600, 800)], "s fw fh") == [800]


def test_boxes_meet_and_unite(spark):
    df = spark.sql("select struct(0 x1, 4 x2, 0 y1, 0 y2) a, struct(0 x1, 4 x2, 1 y1, 1 y2) b")
    row = df.select(G.boxes_meet(F.col("a"), F.col("b"), 0, 1).alias("m"), G.boxes_meet(F.col("a"), F.col("b")).alias("n"), G.boxes_union(F.col("a"), F.col("b")).alias("u")).first()
    assert (row.m, row.n) == (True, False) and tuple(row.u) == (0, 4, 0, 1)


def sides_reference(classes, rtl, opening):
    """The two passes: forward alternation, then backward from the last page that isn't whole."""
    other = {"left": "right", "right": "left"}
    sides, side = [], opening
    for c in classes:
        if c in "ad":
            sides.append("center")
            side = "right" if rtl else "left"
        elif c == "x":
            sides.append(side)
            side = other[side]
        else:
            sides.append({"b": "right" if rtl else "left", "c": "left" if rtl else "right"}[c])
            side = "right" if rtl else "left"
    seen = False
    for k in range(len(classes) - 1, -1, -1):
        if classes[k] != "x":
            seen, side = True, "left" if rtl else "right"
        elif seen:
            sides[k], side = side, other[side]
    return sides


def test_spread_sides(spark):
    rng = random.Random(4)
    rows, want = [], []
    for k in range(60):
        classes = "".join(rng.choice("xxxabcd") for _ in range(rng.randrange(1, 12)))
        for i, c in enumerate(classes):
            nx = next((j for j in range(i + 1, len(classes)) if classes[j] != "x"), None)
            pv = next((j for j in range(i - 1, -1, -1) if classes[j] != "x"), None)
            rows.append((k, i, c, nx, pv))
        want.append(classes)
    df = spark.createDataFrame(rows, "k int, i int, c string, nx int, pv int")
    for rtl in (False, True):
        opening = "right" if rtl else "left"
        got = df.select("k", "i", G.spread_side(F.col("c"), F.col("i"), F.col("nx"), F.col("pv"), rtl, opening).alias("s")).orderBy("k", "i").collect()
        assert [r["s"] for r in got] == [s for classes in want for s in sides_reference(classes, rtl, opening)]
