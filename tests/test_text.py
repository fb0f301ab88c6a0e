"""Name, path and title expressions against literal cases and laws."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.functions import text as T


def values(spark, expression, *rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"c{i} string" for i in range(len(rows[0]))))
    cols = [F.col(f"c{i}") for i in range(len(rows[0]))]
    return [r["v"] for r in df.select("k", expression(*cols).alias("v")).orderBy("k").collect()]


def test_normalize_path(spark):
    cases = {
        "a/../b/c.png": "a/b/c.png", "C:\\comics\\001.png": "comics/001.png", "///a//b///": "a/b", "./": None, ":": None, "a/:::/b": "a/b", "..:/x": "x",
        " a /b:": "a", "": None, "é:/x": "é/x", "c:": None, "a : /b": "a/b",
    }
    assert values(spark, T.normalize_path, *[(k,) for k in cases]) == list(cases.values())
    assert values(spark, T.normalize_path, (None,)) == [None]


def test_normalize_path_is_idempotent_and_never_climbs(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("ab./\\:.") for _ in range(rng.randrange(0, 14))) for _ in range(400)]
    once = values(spark, T.normalize_path, *[(n,) for n in names])
    again = values(spark, T.normalize_path, *[(n,) for n in once])
    assert once == again
    assert not any(part in ("", ".", "..") for n in once if n for part in n.split("/"))


def test_junk(spark):
    names = ["__MACOSX/._page.jpg", "thumbs.db", "__MACOSXfoo/page.jpg", "Chapter\\._x.png", ".ds_store", "a/._b/c.png"]
    assert values(spark, T.is_junk, *[(n,) for n in names]) == [True, True, False, True, True, False]


def test_path_parts(spark):
    assert values(spark, T.extension, ("a/b.JPG",), (".hidden",), ("x",), ("a.b/c",)) == ["jpg", "", "", ""]
    assert values(spark, T.stem, ("a/b.tar.gz",), (".hidden",), ("x",)) == ["b.tar", ".hidden", "x"]
    assert values(spark, T.parent, ("a/b/c",), ("c",)) == ["a/b", ""]
    assert values(spark, T.safe_join, ("base", "../x"), ("base", "..")) == ["base/x", "base"]


def test_matching_root(spark):
    assert values(spark, lambda a, b: T.matches_root(a, b), ("Issue 01", "Issue_01"), ("---", "x"), ("a", None)) == [True, False, False]


def natural_reference(a: str) -> list:
    out = []
    for run in re.findall(r"[0-9]+|[^0-9]+", re.sub(r"\s+", "", a.lower())):
        out.append(run)
    return out


def compare(a: str, b: str) -> int:
    """Character by character; digit runs by value, or digit by digit if one starts with 0."""
    a, b = re.sub(r"\s+", "", a.lower()), re.sub(r"\s+", "", b.lower())
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i].isdigit() and b[j].isdigit():
            p, q = re.match(r"\d+", a[i:]).group(), re.match(r"\d+", b[j:]).group()
            if p[0] == "0" or q[0] == "0":
                if p != q:
                    return -1 if p < q else 1
            elif int(p) != int(q):
                return -1 if int(p) < int(q) else 1
            i, j = i + len(p), j + len(q)
        elif a[i] != b[j]:
            return -1 if a[i] < b[j] else 1
        else:
            i, j = i + 1, j + 1
    return (len(a) - i > 0) - (len(b) - j > 0)


def test_natural_order(spark):
    names = ["page10", "page2", "page1", "Page 3", "a-1", "a1", "a10b", "a2b", "07", "7", "10"]
    keys = dict(zip(names, values(spark, T.natural_key, *[(n,) for n in names])))
    assert sorted(["page10", "page2", "page1", "Page 3"], key=keys.get) == ["page1", "page2", "Page 3", "page10"]
    rng = random.Random(1)
    names = list({"".join(rng.choice("ab1290- ") for _ in range(rng.randrange(1, 8))) for _ in range(300)})
    keys = dict(zip(names, values(spark, T.natural_key, *[(n,) for n in names])))
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names)
        if "0" in a + b:
            continue  # what zeros in front mean is fixed by the key itself
        assert (keys[a] > keys[b]) - (keys[a] < keys[b]) == compare(a, b), (a, b)


def test_folders_come_before_what_is_in_them(spark):
    names = ["Chapter 10", "Chapter 1/Sub", "", "Chapter 2", "Chapter 1"]
    keys = dict(zip(names, values(spark, T.folder_key, *[(n,) for n in names])))
    assert sorted(names, key=keys.get) == ["", "Chapter 1", "Chapter 1/Sub", "Chapter 2", "Chapter 10"]


def test_pad_and_slug(spark):
    def padded(v):
        once = re.sub(r"([0-9]+)", r"0000\1", v, count=2)
        return re.sub(r"0*([0-9]{4,})", r"\1", once)

    rng = random.Random(2)
    names = ["".join(rng.choice("ab01239-") for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    assert values(spark, T.pad_numbers, *[(n,) for n in names]) == [padded(n) for n in names]
    assert values(spark, lambda c: T.pad_numbers(T.slug(c)), ("Chapter 1",), ("Chapter 10",)) == ["chapter-0001", "chapter-0010"]
    assert values(spark, T.slug, ("--A  b!C--",), ("",)) == ["a-b-c", ""]


@pytest.mark.parametrize("width", [1, 3, 6])
@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"[+-]?[0-9]{0,7}", fullmatch=True), min_size=1, max_size=20))
def test_zfill(spark, width, texts):
    assert values(spark, lambda c: T.zfill(c, width), *[(t,) for t in texts]) == [t.zfill(width) for t in texts]


def test_titles(spark):
    def full(*c):
        return T.book_title(*c, combine=True)

    rows = [("f", "Berserk", "3", "7", "X"), ("f", None, "", None, ""), ("f", "S", None, "12", None)]
    assert values(spark, full, *rows) == ["Berserk Vol. 03 #007: X", "f", "S #012"]
    assert values(spark, lambda v, n: T.group_position(v, n), ("3", "7"), ("", "7"), (None, None), ("3", "")) == ["3.7", "7", None, "3"]
    assert values(spark, lambda b: T.shard_title(b, F.lit(2), F.lit(2)), ("book",)) == ["book [2/2]"]
    assert values(spark, lambda b: T.shard_title(b, F.lit(2), F.lit(12)), ("book",)) == ["book [02/12]"]


def test_markup(spark):
    assert values(spark, T.html_escape, ("a & <b> \"'",)) == ["a &amp; &lt;b&gt; &quot;&#x27;"]
    assert values(spark, T.normalize_line_ends, ("a\r\nb\rc\n",)) == ["a\nb\nc\n"]
    assert values(spark, lambda b, r: T.resolve_relative(b, r), ("OEBPS/Text", "../Images/1.jpg"), ("", "../../x"), ("a", "/b/c"), ("a", ".\\b")) == ["OEBPS/Images/1.jpg", "x", "b/c", "a/b"]
    assert values(spark, T.strip_fusion_prefix, ("fusion_0001_b",), ("fusion_1_b",)) == ["b", "fusion_1_b"]
    assert values(spark, lambda a, b: F.array_join(T.people(a, b), "|"), ("B, A", "A, "), (None, "")) == ["A|B", "cb"]
