"""Ordered groups in parts, folders as wholes, names and layouts: against plain computation, and edges."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quirefold.functions import layout as L
from quirefold.functions import naming as N
from quirefold.operators import trees
from quirefold.operators.joins import as_of_join
from quirefold.operators.ordering import Ordered, number_rows, runs


@pytest.fixture
def many_parts(spark):
    """Small frames aren't put back together, so groups do lie in several parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ordered_groups_of_any_size(spark, many_parts):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), k, rng.choice(["x", "x", "y", None]), rng.choice([None, rng.randrange(100)])) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, v string, n int").repartition(7)
    by = defaultdict(list)
    for g, k, v, n in rows:
        by[g].append((k, v, n))
    marked = Ordered(df, ["g"], ["k"]).number("i").before("prior", "v").sums(total=F.coalesce("n", F.lit(0))).highest("most", F.col("n")).highest("top", F.col("n"), itself=True)
    assert marked.df.select("_part").distinct().count() > 1
    got = {(r.g, r.k): (r.i, r.prior, r.total, r.most, r.top) for r in marked.frame().collect()}
    for g, items in by.items():
        total, most, prior = 0, None, None
        for i, (k, v, n) in enumerate(sorted(items), 1):
            total += n or 0
            top = most if n is None else n if most is None else max(most, n)
            assert got[g, k] == (i, prior, total, most, top)
            most, prior = top, v
    run = {(r.g, r.k): r.run for r in runs(df, ["g"], ["k"], "v").collect()}
    for g, items in by.items():
        at, last = -1, object()
        for k, v, _ in sorted(items):
            at, last = at + (v != last), v
            assert run[g, k] == at
    assert number_rows(df.limit(0), ["g"], ["k"]).collect() == []


def test_as_of_join_of_one_key(spark, many_parts):
    rng = random.Random(2)
    left = [(rng.choice(["u", None]), rng.choice([None, rng.randrange(50)]), k) for k in range(120)]
    right = [("u", rng.choice([None, rng.randrange(50)]), k) for k in range(60)] + [(None, 1, 99)]
    out = as_of_join(spark.createDataFrame(left, "u string, t int, id int"), spark.createDataFrame(right, "u string, rt int, v int"), ["u"], "t", "rt", ["v"])
    for r in out.collect():
        seen = [(rt, v) for u, rt, v in right if u == r.u and u is not None and rt is not None and r.t is not None and rt <= r.t]
        assert r.v == (max(seen)[1] if seen else None)
    assert out.count() == 120


def test_folders(spark):
    files = ["a/1.png", "a/2.txt", "b/c/1.jpg", "b/d/2.jpg", "e/x/1.png", "e/y.cbz", "f/g/h/1.webp", "z.cbz", None]
    df = spark.createDataFrame([(f, bool(f and f.endswith("cbz"))) for f in files], "path string, archive boolean")
    got = {r.folder: (r.has_images, r.has_archives, r.any_images, r.image_folders, r.standalone) for r in trees.folder_facts(df, [], "path", "archive").collect()}
    assert got["a"] == (True, False, True, 0, True) and got["b"] == (False, False, True, 2, False) and got["e"] == (False, True, True, 1, False)
    assert got["f"] == (False, False, True, 1, True) and got[""] == (False, True, True, 4, False)
    listing = spark.createDataFrame([("s/" + f, False, "zip" if f.endswith("cbz") else None) for f in files if f] + [(f"s/{d}", True, None) for d in "abef"] + [("s/old.cbr", False, "rar")], "path string, is_dir boolean, kind string")
    facts = trees.folder_facts(listing.where("not is_dir").withColumn("archive", F.col("kind").isNotNull()), [], "path", "archive")
    tasks = [(r.source, r.destination, r.skipped) for r in trees.convert_tasks(listing, facts, "s", "cbz").collect()]
    assert tasks == [("s/a", "s/a.cbz", False), ("s/b", "s/b.cbz", False), ("s/e", "s/e.cbz", False), ("s/f", "s/f.cbz", False), ("s/old.cbr", "s/old.cbz", False), ("s/z.cbz", "s/z.cbz", True)]
    assert [(r.source, r.destination) for r in trees.convert_tasks(listing, facts, "s/a", "cbt").collect()] == [("s/a", "s/a.cbt")]
    assert [r.source for r in trees.convert_tasks(listing, facts, "s", "dir").collect()] == ["s/old.cbr", "s/z.cbz"] and trees.convert_tasks(listing, facts, "s/a", "dir").collect() == []
    assert [r.path for r in trees.clamp_inputs(listing, "s", "s/b").collect()] == ["s/a", "s/e", "s/f", "s/old.cbr", "s/z.cbz"]
    covers = spark.createDataFrame([(p,) for p in ("s/v10.cbz", "s/v2.cbz", "s/x.cbr", "s/Covers/b.jpg", "s/Covers/a.png", "s/Covers/t.txt", "q/v1.cbz")], "path string")
    assert {r.source: r.cover for r in trees.sibling_covers(covers, "path").collect()} == {"s/v2.cbz": "s/Covers/a.png", "s/v10.cbz": "s/Covers/b.jpg", "s/x.cbr": "s/Covers/a.png"}


def test_strips(spark):
    pages = spark.createDataFrame([("b", k, h) for k, h in enumerate([10, None, 5])], "b string, k int, h int")
    assert [(r.offset, r.strip_height) for r in trees.merge_offsets(pages, ["b"], ["k"], "h").orderBy("k").collect()] == [(0, 15), (10, 15), (10, 15)]
    with pytest.raises(Exception, match="too tall"):
        trees.merge_offsets(pages, ["b"], ["k"], "h", limit=14).collect()
    parts = spark.createDataFrame([("b", 0, 50), ("b", 50, 90), ("b", 90, 100), ("b", 100, 300)], "b string, top long, bottom long")
    assert [(r.page, r.top, r.bottom, r.n_panels, r.rows) for r in trees.strip_pages(parts, ["b"], "top", "bottom", 100).orderBy("page").collect()] == [(1, 0, 90, 2, 90), (2, 100, 300, 1, 200)]
    assert [r.k for r in trees.nth_of(pages, ["b"], ["k"], 2).collect()] == [1] and trees.nth_of(pages, ["b"], ["k"], 4).collect() == []


def books(rows):
    return [(b, c, f"{c}/{p}" if c else str(p), o, p, s, None) for b, c, o, p, s in rows]


def test_divided_books(spark):
    schema = "b string, c string, path string, o int, p int, s long, half string"
    flat = [("flat", "", 1, k, 40) for k in range(5)]
    chapters = [("ch", f"c{k}", k, 1, 60) for k in range(3)]
    heavy = [("heavy", "c0", 0, k, 70) for k in range(2)] + [("heavy", "c1", 1, 9, 10)]
    mixed = [("mixed", "", 0, 1, 10), ("mixed", "c1", 1, 2, 10)]
    deep = [("deep", f"{t}/{k}", k, 1, 5) for k, t in enumerate("AABA")]
    df = spark.createDataFrame(books(flat + chapters + heavy + mixed + deep), schema)
    modes = {r.b: (r.level, r.mixed, r.flatten, r["mode"]) for r in trees.split_modes(df, "b", "path", "c", "s", 100).collect()}
    assert modes == {"flat": (1, False, False, "pages"), "ch": (2, False, False, "chapters"), "heavy": (2, False, True, "pages"), "mixed": (1, True, True, "pages"), "deep": (3, False, False, "folders")}
    out = defaultdict(list)
    for r in trees.split_books(df, "b", "path", "c", ["o", "p"], "s", "half", 100).orderBy("b", "o", "p").collect():
        out[r.b].append((r.tome, r.tome_chapter))
    assert [t for t, _ in out["flat"]] == [1, 1, 2, 2, 3] and out["ch"] == [(1, "c0"), (2, "c1"), (3, "c2")] and out["deep"] == [(1, "A/0"), (1, "A/1"), (2, "B/2"), (3, "A/3")]
    assert out["heavy"] == [(1, ""), (2, ""), (2, "")] and out["mixed"] == [(1, ""), (1, "")]
    assert {r["mode"] for r in trees.split_modes(df.where("b = 'ch'"), "b", "path", "c", "s", 100, "folders").collect()} == {"folders"}
    assert {(r.path, r.c) for r in trees.flatten_chapters(df.where("b = 'ch'"), "path", "c").collect()} == {("1", "")}


def test_names_and_layouts(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).collect()[0].v

    lit = F.lit
    assert one(N.strip_prefix(lit("a/b"), lit("a"))) == "b" and one(N.strip_prefix(lit("ab/c"), lit("a"))) is None and one(N.strip_prefix(lit("a"), lit("a"))) is None
    assert one(N.byte_place(lit(b"\x12\x34\x56"), b"\x23")) == -1 and one(N.byte_place(lit(b"ab"), b"b")) == 1
    assert one(N.book_name(lit("x/My-Book!.cbz"), lit(False), "kepub_short", lit(""), lit(None))) == "x/My_Book_.kepub"
    assert one(L.strip_pads(lit(299))) is None and one(L.strip_pads(lit(300))).asDict() == {"v": 4, "h": 15, "step": 2}
    assert one(L.panel_grid(L.magnified(lit(1000), lit(1000), lit(1600), lit(1000)), lit(1600), lit(1000))) == "stacked"
    assert [r.ordinal for r in one(L.panel_regions(L.magnified(lit(2000), lit(2000), lit(1000), lit(1000), "fine"), lit(1000), lit(1000), lit(True)))] == [2, 4, 1, 3]
    assert one(L.render_zoom(L.render_size(lit(10), lit(20)), lit(0), lit(0))) == 1.0 and one(L.kept_crop(F.struct(lit(1).alias("left"), lit(1).alias("top"), lit(2).alias("right"), lit(2).alias("bottom")), lit(0), lit(0))) is None
    assert one(L.clipped(lit(-5), lit(9), lit(4))).asDict() == {"start": 0, "stop": 4} and L.clamp_limit("max-width", 401) == 401
