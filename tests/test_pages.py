"""Page work, divided books, metadata in books, and jobs on equal names."""

import os
import zipfile

import numpy as np
import pytest

from quirefold.pixels import kernels, png
from quirefold.pixels.pages import encoded, prepared
from quirefold.plans.pipeline import Options, PageWork, convert, ebook, navigation
from quirefold.sources.archives import book_names, pages_of, read_archives


def picture(seed, h=60, w=40):
    rng = np.random.default_rng(seed)
    return png.encode(rng.integers(0, 256, (h, w), dtype=np.uint8))


def box(path, names, info=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for k, name in enumerate(names):
            z.writestr(name, picture(k))
        if info:
            z.writestr("ComicInfo.xml", info)


INFO = "<ComicInfo><Series>Salt &amp; Ink</Series><Volume>2</Volume><Number>7</Number><Title>Deep</Title><Writer>Roe, Ann</Writer><Summary>Short.</Summary></ComicInfo>"


def test_equal_names_make_books_of_their_own(spark, tmp_path):
    box(str(tmp_path / "in/a/x.cbz"), ["1.png", "2.png"])
    box(str(tmp_path / "in/b/x.cbz"), ["p/7.png", "p/8.png"])
    out = convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), Options(kind="tar")).collect()
    assert sorted(r.book for r in out) == ["x", "x~2"] and [r.n_entries for r in out] == [2, 2]
    listed = {r.src.rsplit("/", 1)[1]: 0 for r in read_archives(spark, str(tmp_path / "out")).collect()}
    assert set(listed) == {"x.cbt", "x~2.cbt"}
    names = spark.createDataFrame([("a/x.cbz",), ("b/x.cbz",), ("c/x~2.cbz",), (None,), ("a/x.cbz",)], "src string")
    got = {r.src: r.book_id for r in book_names(names).collect()}
    assert got == {"a/x.cbz": "x", "b/x.cbz": "x~2", "c/x~2.cbz": "x~2~1"}
    matching = convert(spark, str(tmp_path / "in/b/x.cbz"), str(tmp_path / "m"), Options(kind="dir", strip_root="matching")).collect()
    assert sorted(os.listdir(matching[0].path)) == ["p"]


def test_books_carry_their_metadata_and_are_divided(spark, tmp_path):
    source = str(tmp_path / "in/tale.cbz")
    box(source, [f"T/ch {k}/{j}.png" for k in (1, 2, 10) for j in range(3)], INFO)
    ebook(spark, source, str(tmp_path / "whole"), Options(kind="epub", title_mode="combine")).collect()
    with zipfile.ZipFile(tmp_path / "whole/tale.epub") as z:
        package = z.read("EPUB/package.opf").decode()
        assert "<dc:title>Salt &amp; Ink Vol. 02 #007: Deep</dc:title>" in package and "<dc:creator>Ann</dc:creator>" in package and ">2.7</meta>" in package and "<dc:description>Short.</dc:description>" in package
        assert z.read("EPUB/contents.xhtml").decode().count("<li>") == 3 and 'properties="cover-image"' in package and package.count("<itemref") == 9
    size = len(picture(0)) * 3 // 1024
    assert size < 1024
    parts = ebook(spark, source, str(tmp_path / "parts"), Options(kind="epub", batch="folders", title="Mine")).collect()
    assert sorted(r.book for r in parts) == ["tale-001", "tale-002", "tale-003"]
    with zipfile.ZipFile(tmp_path / "parts/tale-002.epub") as z:
        assert "<dc:title>Mine [2/3]</dc:title>" in z.read("EPUB/package.opf").decode()
    ebook(spark, source, str(tmp_path / "cbz"), Options(kind="zip", keep_info=True)).collect()
    with zipfile.ZipFile(tmp_path / "cbz/tale.cbz") as z:
        assert [n for n in z.namelist() if not n.endswith("/")][0] == "ComicInfo.xml" and z.namelist()[-1] == "ch 10/2.png"


def test_page_work(spark, tmp_path):
    page = np.full((300, 200), 250, np.uint8)
    page[30:270, 20:180] = 10
    work = PageWork(width=50, height=60, levels=16)
    small = prepared(page, work)
    assert small.shape == (60, 40) or max(small.shape[0] / 60, small.shape[1] / 50) <= 1.0
    assert int(small.min()) == 0 and png.decode(encoded(small, 16)).shape[:2] == small.shape
    colour = np.dstack([page, 255 - page, page])
    assert prepared(colour, PageWork()).ndim == 2 and prepared(colour, PageWork(colour=True)).ndim == 3
    pale = np.clip(page, 100, 160)
    assert (prepared(pale, PageWork(crop=False, width=999, height=999)) == pale).all()
    with pytest.raises(ValueError):
        PageWork(gamma=0)
    with pytest.raises(ValueError, match="size_threshold must be > 500,000"):
        Options(clamp_by="split", clamp_limit=500_000)
    box(str(tmp_path / "in/b.cbz"), ["1.png", "2.png"])
    ebook(spark, str(tmp_path / "in/b.cbz"), str(tmp_path / "o"), Options(kind="zip", work=PageWork(width=20, height=20, levels=4))).collect()
    done = pages_of(read_archives(spark, str(tmp_path / "o/b.cbz"))).collect()
    assert all(max(png.decode(bytes(r.content)).shape[:2]) <= 20 for r in done) and len(done) == 2


def one_by_one(plane, levels):
    h, w = plane.shape
    left = np.pad(plane.astype(float), ((0, 1), (1, 1)))
    out = np.zeros((h, w), np.uint8)
    for y in range(h):
        for x in range(1, w + 1):
            k = int(np.argmin(np.abs(levels - left[y, x])))
            e = left[y, x] - levels[k]
            out[y, x - 1] = k
            for dy, dx, n in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                left[y + dy, x + dx] += e * n / 16
    return out


def test_kernels_against_plain_loops():
    rng = np.random.default_rng(4)
    for h, w in ((1, 1), (1, 9), (9, 1), (7, 13), (20, 8)):
        plane = rng.integers(0, 256, (h, w), dtype=np.uint8)
        levels = np.array([0.0, 85.0, 170.0, 255.0])
        assert (kernels.dither(plane, levels) == one_by_one(plane, levels)).all()
    pixels = rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    assert np.abs(kernels.from_yuv(kernels.to_yuv(pixels)).astype(int) - pixels).max() <= 1
    flat = np.full((4, 4), 9, np.uint8)
    assert (kernels.keep_tone_contrast(flat) == flat).all() and kernels.keep_tone_contrast(pixels).max() == 255 and kernels.erase_moire(pixels).shape == pixels.shape
    dark = np.array([[5, 5, 5, 90, 200]], np.uint8)
    assert kernels.raise_black(dark).min() == 5


def test_navigation(spark):
    pages = spark.createDataFrame([("b", n, c) for n, c in enumerate("xbcxbcx", 1)], "book_id string, n int, order_class string")
    infos = spark.createDataFrame([("b", [(0, "start"), (2, "mid"), (99, "out")])], "book_id string, bookmarks array<struct<image:int,title:string>>")
    assert [(r.mark, r.image, r.title, r.page) for r in navigation(pages, infos).orderBy("mark").collect()] == [(0, 0, "start", "cb-0001"), (1, 3, "mid", "cb-0004")]


def test_sources_of_any_kind(spark, tmp_path):
    from quirefold.sources.books import list_archives, load_pages

    box(str(tmp_path / "in/x.cbz"), ["c/1.png", "c/2.png"])
    box(str(tmp_path / "in/plain.epub"), ["p/1.png"])
    box(str(tmp_path / "in/none.cbz"), [])
    with zipfile.ZipFile(tmp_path / "in/notes.cbz", "w") as z:
        z.writestr("a.txt", "no page")
    body = b"\xff\xd8" + b"j" * 400 + b"\xff\xd9"
    (tmp_path / "in/doc.pdf").write_bytes(b"%PDF-1.4\nobj stream\n" + body + b"\nendstream\n")
    (tmp_path / "in/old.cbr").write_bytes(b"Rar!\x1a\x07\x00rest")
    ebook(spark, str(tmp_path / "in/x.cbz"), str(tmp_path / "in"), Options(kind="epub")).collect()
    got = {}
    for r in load_pages(spark, str(tmp_path / "in")).collect():
        got.setdefault(os.path.basename(r.src), []).append((r.kind, r.path, r.error))
    assert len(got["x.cbz"]) == 2 and len(got["x.epub"]) == 2 and got["x.epub"][0][0] == "epub"
    assert got["plain.epub"] == [("epub", "1.png", None)] and got["doc.pdf"] == [("pdf", "00001.jpg", None)]
    assert got["notes.cbz"][0][2] == "no pages" and got["none.cbz"][0][2] == "no pages" and "unsupported" in got["old.cbr"][0][2]
    with pytest.raises(Exception, match="no pages|unsupported"):
        load_pages(spark, str(tmp_path / "in"), strict=True).collect()
    listed = {}
    for r in list_archives(spark, str(tmp_path / "in/*.cb*")).collect():
        listed.setdefault(os.path.basename(r.src), []).append((r.name, r.error))
    assert [n for n, _ in listed["x.cbz"]] == ["c/1.png", "c/2.png"] and listed["old.cbr"][0][1] == "unsupported container"
