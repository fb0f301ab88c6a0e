"""Containers, headers, EPUB, whole jobs and streams: the same pages whatever they come in."""

import io
import os
import struct
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.pixels import kernels, png
from quirefold.plans.pipeline import Options, clamp, convert, ebook
from quirefold.sinks.archives import write_books
from quirefold.sources.archives import classify, pages_of, read_archives, read_folder, sniff_kind
from quirefold.sources.epub import comic_info, epub_pages, parse_comic_info
from quirefold.sources.headers import jpeg_streams, size_of

FILES = {"Root/Chapter 10/z.png": (5, 4), "Root/Chapter 2/b.png": (30, 20), "Root/Chapter 2/a10.png": (6, 6), "Root/Chapter 2/a2.png": (7, 6), "Root/cover.png": (8, 8)}
ORDER = ["cover.png", "Chapter 2/a2.png", "Chapter 2/a10.png", "Chapter 2/b.png", "Chapter 10/z.png"]


def image(w, h):
    return png.encode(np.arange(w * h, dtype=np.uint8).reshape(h, w))


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    root = tmp_path_factory.mktemp("shelf")
    files = {k: image(*v) for k, v in FILES.items()} | {"Root/.DS_Store": b"x", "__MACOSX/Root/._a.png": b"x", "Root/ComicInfo.xml": b"<ComicInfo><Series>S</Series></ComicInfo>"}
    with zipfile.ZipFile(root / "book.cbz", "w") as z:
        z.writestr("Root/", b"")
        for k, v in files.items():
            z.writestr(k, v)
    with tarfile.open(root / "other.cbt", "w") as t:
        for k, v in files.items():
            info = tarfile.TarInfo(k)
            info.size = len(v)
            t.addfile(info, io.BytesIO(v))
    for k, v in files.items():
        path = root / "plain" / k
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(v)
    (root / "broken.cbz").write_bytes(b"PK\x03\x04 not a zip")
    (root / "odd.cbr").write_bytes(b"Rar!\x1a\x07\x00rest")
    (root / "empty.cbz").write_bytes(b"")
    return root


def test_same_pages_from_every_container(spark, shelf):
    found = pages_of(read_archives(spark, f"{shelf}/*.cb*")).orderBy("src", "page_ord").collect()
    by = {}
    for r in found:
        by.setdefault(os.path.basename(r.src), []).append(r)
    plain = pages_of(read_folder(spark, f"{shelf}/plain")).orderBy("page_ord").collect()
    assert set(by) == {"book.cbz", "other.cbt"}
    for rows in (*by.values(), plain):
        assert [r.path for r in rows] == ORDER and [r.chapter_ord for r in rows] == [1, 2, 2, 2, 3]
        assert [size_of(bytes(r.content)) for r in rows] == [FILES["Root/" + p] for p in ORDER]


def test_unreadable_containers_are_rows(spark, shelf):
    rows = read_archives(spark, f"{shelf}/*.cb*").where("error is not null").collect()
    assert {os.path.basename(r.src) for r in rows} == {"broken.cbz", "odd.cbr"}  # the file scan passes empty files over
    with pytest.raises(Exception, match="broken|unsupported|Bad"):
        read_archives(spark, f"{shelf}/*.cb*", strict=True).collect()
    names = read_archives(spark, f"{shelf}/book.cbz", bodies=False).collect()
    assert all(r.content is None for r in names) and len(names) == 9
    roles = {r.path: r.role for r in classify(read_archives(spark, f"{shelf}/book.cbz")).collect()}
    assert roles["Root"] == "folder" and roles["Root/ComicInfo.xml"] == "metadata" and roles["Root/.DS_Store"] == "junk"


@pytest.mark.parametrize("kind", ["zip", "tar", "dir"])
def test_round_trip(spark, shelf, tmp_path, kind):
    pages = pages_of(read_archives(spark, f"{shelf}/book.cbz")).withColumn("book_id", F.lit("b"))
    done = write_books(pages, str(tmp_path), kind, order=("page_ord",), name="path").collect()
    assert [(r.book, r.n_entries) for r in done] == [("b", 5)]
    back = read_folder(spark, done[0].path) if kind == "dir" else read_archives(spark, done[0].path)
    assert {r.path: bytes(r.content) for r in pages_of(back).collect()} == {p: image(*FILES["Root/" + p]) for p in ORDER}
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".part")]


def test_sniff(spark, shelf):
    files = spark.read.format("binaryFile").load(f"{shelf}/*.cb*").select("path", sniff_kind(F.col("content"), F.col("path")).alias("k")).collect()
    assert {os.path.basename(r.path): r.k for r in files} == {"book.cbz": "zip", "other.cbt": "tar", "broken.cbz": "zip", "odd.cbr": "rar"}


def test_jobs(spark, shelf, tmp_path):
    out = {r.book: r for r in convert(spark, f"{shelf}/*.cb*", str(tmp_path / "c"), Options(kind="tar", strip_root="always")).collect()}
    assert out["book"].error is None and out["broken"].error and out["odd"].error
    assert [r.path for r in pages_of(read_archives(spark, str(tmp_path / "c" / "book.cbt"))).orderBy("page_ord").collect()] == ORDER
    clamp(spark, f"{shelf}/book.cbz", str(tmp_path / "k"), Options(width=10, height=10)).collect()
    small = pages_of(read_archives(spark, str(tmp_path / "k" / "book.cbz"))).orderBy("page_ord").collect()
    assert [r.path for r in small] == [f"{k:03d}.png" for k in range(1, 6)] and [size_of(bytes(r.content)) for r in small] == [(8, 8), (7, 6), (6, 6), (10, 7), (5, 4)]
    books = spark.createDataFrame([("book", "A & B", ["Roe"])], "book_id string, title string, authors array<string>")
    ebook(spark, f"{shelf}/book.cbz", str(tmp_path / "e"), Options(kind="epub"), books).collect()
    with zipfile.ZipFile(tmp_path / "e" / "book.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.read("mimetype") == b"application/epub+zip"
        assert b"A &amp; B" in z.read("EPUB/package.opf") and z.read("EPUB/contents.xhtml").count(b"<li>") == 3
    pages = epub_pages(read_archives(spark, str(tmp_path / "e" / "book.epub"))).orderBy("page_ord").collect()
    assert [size_of(bytes(r.content)) for r in pages] == [FILES["Root/" + p] for p in ORDER]
    with pytest.raises(ValueError):
        Options(kind="7z")


def test_headers():
    assert size_of(image(3, 2)) == (3, 2) and size_of(None) is None and size_of(b"\x89PNG\r\n\x1a\n") is None
    assert size_of(b"GIF89a" + struct.pack("<HH", 4, 5)) == (4, 5)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\x01"
    assert size_of(jpeg) == (9, 7) and size_of(b"\xff\xd8\xff") is None
    body = b"\xff\xd8" + b"j" * 400 + b"\xff\xd9"
    assert jpeg_streams(b"obj stream\n" + body + b"\nendstream x stream\nnothing endstream") == [body]


def test_comic_info(spark):
    xml = b'<c><a:Series xmlns:a="u">S</a:Series><Series>T</Series><Pages><Page Image="1" Bookmark="x"/><Page Image="-1" Bookmark="y"/></Pages><Writer>A, B</Writer></c>'
    assert comic_info(xml)["series"] == "S" and comic_info(xml)["bookmarks"] == [{"image": 1, "title": "x"}] and comic_info(b"<a>") is None
    got = spark.createDataFrame([(xml,), (b"<a",), (None,)], "c binary").select(parse_comic_info(F.col("c")).alias("m")).collect()
    assert got[0].m.writers == "A, B" and got[1].m is None and got[2].m is None


def test_png_and_kernels():
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (4, 3, 3)):
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (png.decode(png.encode(pixels)) == pixels).all()
    index = rng.integers(0, 4, (5, 7), dtype=np.uint8)
    palette = np.array([[0] * 3, [85] * 3, [170] * 3, [255] * 3], np.uint8)
    assert (png.decode(png.encode(index, palette, bits=2)) == palette[index]).all()
    with pytest.raises(ValueError):
        png.decode(b"nothing")
    page = np.full((300, 200), 255, np.uint8)
    page[30:270, 20:180] = 0
    assert [kernels.margin_box(page, p) for p in (0.0, 1.0, 2.0, 3.0)] == [(19, 29, 181, 271), (19, 29, 181, 271), (20, 30, 180, 270), (20, 30, 180, 270)]
    assert kernels.background(page) == "white" or kernels.background(255 - page) in ("black", "white")
    counts = rng.integers(0, 9, 256)
    trimmed = kernels.trim_ends(counts, 50)
    assert trimmed.sum() == counts.sum() - 100 and (trimmed <= counts).all()
    assert not kernels.is_colour(np.repeat(page[..., None], 3, 2)) and kernels.is_colour(np.dstack([page, 255 - page, page]))
    assert kernels.resize(page, 100, 150).shape == (150, 100) and abs(int(kernels.resize(page, 100, 150)[75, 50])) < 3
    assert (kernels.dither(np.full((6, 6), 128, np.uint8), [0, 255]).mean() - 0.5) < 0.1
    ycc = kernels.to_ycc(np.array([[[255, 0, 0], [10, 10, 10]]], np.uint8))
    assert ycc[0, 1].tolist() == [10, 128, 128] and np.abs(kernels.from_ycc(ycc).astype(int) - [[[255, 0, 0], [10, 10, 10]]]).max() <= 2
    assert kernels.without_gutters(page, page < 128, 0).shape == page.shape and kernels.black_point(page) == 0


def test_stream_of_archives(spark, shelf, tmp_path):
    from quirefold.sources.archives import stream_archives

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "book.cbz").write_bytes((shelf / "book.cbz").read_bytes())
    query = stream_archives(spark, str(folder)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("arrived").count() == 9


def test_event_streams(spark, tmp_path):
    from quirefold.streaming.windows import running_runs, tumbling_counts, with_event_time

    rows = [(1, "a", "2024-01-01 00:00:00", 1.0), (1, "a", "2024-01-01 00:30:00", 2.0), (1, "b", "2024-01-01 01:00:00", 3.0), (2, "a", "2024-01-01 05:00:00", 4.0)]
    df = spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    query = tumbling_counts(with_event_time(stream), ["event_type"], "1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("hours").collect()) == [("a", 1, 4.0), ("a", 2, 3.0), ("b", 1, 3.0)]
    query = running_runs(stream, "user_id", "event_type").writeStream.outputMode("update").format("memory").queryName("runs").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("runs").collect()) == [(1, "b", 1), (2, "a", 1)]
