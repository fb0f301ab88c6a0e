"""Whole jobs: converting containers, clamping page sizes, and making books."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.layout import clamp_limit, clamp_measure, shard_bytes
from quirefold.functions.naming import strip_prefix
from quirefold.functions.text import base_name, book_title, is_directory, matches_root, media_type, normalize_path, page_name, people, shard_title, stem
from quirefold.functions.text import extension as extension_of
from quirefold.operators.folds import bookmark_targets
from quirefold.operators.grouping import all_within, single_root
from quirefold.operators.trees import split_books
from quirefold.sinks.archives import SUFFIX, write_books
from quirefold.sinks.epub import cbz_entries, epub_entries
from quirefold.sources.archives import book_names, comic_infos, pages_of, read_archives, sniff_kind
from quirefold.sources.epub import parse_comic_info
from quirefold.sources.headers import image_size

MEBIBYTE = 1024 * 1024


@dataclass(frozen=True)
class Options:
    """What is to be made, checked when it is stated.

    title_mode is ``default`` (series, volume and number), ``combine`` (and the title) or ``only`` (the
    title alone); ``title`` and ``author`` overrule what a book says of itself.  ``batch`` is how books
    are divided: ``auto`` by size, ``folders`` by top folder; they aren't unless it or shard_mib is set.
    """

    kind: str = "zip"
    width: int = 1072
    height: int = 1448
    shard_mib: int | None = None
    batch: str | None = None
    right_to_left: bool = False
    strip_root: str = "never"
    clamp_by: str = "frame"
    clamp_limit: int = 0
    title: str | None = None
    author: str | None = None
    title_mode: str = "default"
    keep_info: bool = False
    work: PageWork | None = None

    def __post_init__(self) -> None:
        if self.kind not in SUFFIX:
            raise ValueError(f"kind is one of {', '.join(SUFFIX)}")
        if self.width < 1 or self.height < 1:
            raise ValueError("width and height are positive")
        if self.shard_mib is not None and self.shard_mib < 1:
            raise ValueError("shard_mib is positive")
        for name, allowed in (("strip_root", ("never", "always", "matching")), ("title_mode", ("default", "combine", "only")), ("batch", (None, "auto", "folders"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {allowed}")
        if self.clamp_by != "frame":
            clamp_limit(self.clamp_by, self.clamp_limit)

    @property
    def divides(self) -> bool:
        return self.batch is not None or self.shard_mib is not None


@dataclass(frozen=True)
class PageWork:
    """What is done to the pixels of a page, in this order: cropping, gamma, grey, contrast, size, moiré, palette."""

    crop: bool = True
    crop_power: float = 1.0
    gamma: float = 1.0
    colour: bool = False
    contrast: bool = True
    level: bool = False
    width: int = 1072
    height: int = 1448
    upscale: bool = False
    moire: bool = False
    levels: int = 0

    def __post_init__(self) -> None:
        if self.width < 1 or self.height < 1 or self.gamma <= 0 or not 0 <= self.crop_power <= 3 or self.levels not in (0, *range(2, 257)):
            raise ValueError("no such work on pages")


def convert(spark: SparkSession, source: str, folder: str, options: Options = Options()) -> DataFrame:
    """Containers under ``source`` in another kind, entry by entry; unreadable ones are skipped and come back as errors.

    Each source makes one container, also where file names repeat in several folders.  One shared top
    folder is dropped (``always``), or only if it is named like the container (``matching``).  Evaluating
    the frame (book, path, n_entries, bytes, error) does the work.
    """
    entries = read_archives(spark, source)
    names = book_names(entries)
    bad = entries.where("error is not null").select("src", "error").join(names, "src").select(F.col("book_id").alias("book"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("n_entries"), F.lit(0).cast("long").alias("bytes"), "error")
    good = entries.where("error is null").withColumn("path", normalize_path(F.col("name"))).where("path is not null").withColumn("folder", is_directory(F.col("name"), F.col("is_dir")))
    if options.strip_root != "never":
        roots = single_root(good, "src", "path", "folder").where("root is not null")
        if options.strip_root == "matching":
            roots = roots.where(matches_root(F.col("root"), stem(base_name(F.col("src")))))
        good = good.join(roots, "src", "left").withColumn("path", F.when(F.col("root").isNull(), F.col("path")).otherwise(strip_prefix(F.col("path"), F.col("root")))).where("path is not null")
    rows = good.join(names, "src").select("book_id", F.col("pos").alias("entry_ord"), F.col("path").alias("name"), "content")
    written = write_books(rows, folder, options.kind)
    return written.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


def already_done(spark: SparkSession, source: str, kind: str) -> DataFrame:
    """Containers that are of the wanted kind already and need no conversion: src."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    return files.where(sniff_kind(F.col("content"), F.col("path")) == kind).select(F.col("path").alias("src"))


def clamp(spark: SparkSession, source: str, folder: str, options: Options = Options()) -> DataFrame:
    """PNG pages of containers no larger than the frame, renumbered in reading order; pages that fit are copied as they are.

    With ``clamp_by`` (split, resize, max-width) and its limit, books in which every page is below the
    limit are copied as they are.
    """
    from quirefold.pixels.pages import fit_pages

    pages = pages_of(read_archives(spark, source).where("error is null")).withColumn("size", image_size(F.col("content")))
    sized = pages.select("src", "page_ord", "path", "content", F.col("size.width").alias("width"), F.col("size.height").alias("height"))
    if options.clamp_by != "frame":
        small = all_within(sized, ["src"], clamp_measure(options.clamp_by, F.col("width"), F.col("height")), options.clamp_limit)
        marked = sized.join(small, "src")
        fitted = fit_pages(marked.where("not within").drop("within"), options.width, options.height).unionByName(marked.where("within").select("src", "page_ord", "path", "content"), allowMissingColumns=True)
    else:
        fitted = fit_pages(sized, options.width, options.height)
    name = F.concat(F.format_string("%03d", F.col("page_ord").cast("int")), F.regexp_extract("path", r"(\.[^./]*)$", 1))
    named = fitted.join(book_names(pages), "src")
    return write_books(named.select("book_id", F.col("page_ord").alias("entry_ord"), name.alias("name"), "content"), folder, options.kind)


def book_infos(entries: DataFrame, names: DataFrame, options: Options) -> DataFrame:
    """What each book says of itself: book_id, title, authors, series, volume, number, summary, bookmarks, document.

    A malformed or missing metadata document leaves the defaults: the name of the source and ``cb``.
    """
    own = comic_infos(entries).withColumn("m", parse_comic_info(F.col("content")))
    found = names.join(own, "src", "left")
    m = {c: F.col(f"m.{c}") for c in ("series", "volume", "number", "title", "summary")}
    default = stem(base_name(F.col("src")))
    if options.title_mode == "only":
        title: Column = F.when(F.col("m").isNotNull(), F.coalesce(m["title"], F.lit(""))).otherwise(default)
    else:
        title = book_title(default, m["series"], m["volume"], m["number"], m["title"], combine=options.title_mode == "combine")
    if options.title is not None and options.title_mode != "only":
        title = F.lit(options.title)
    authors = F.array(F.lit(options.author)) if options.author is not None else people(F.col("m.writers"), F.col("m.pencillers"), F.col("m.inkers"), F.col("m.colorists"))
    return found.select("book_id", title.alias("title"), authors.alias("authors"), m["series"].alias("series"), m["volume"].alias("volume"), m["number"].alias("number"), m["summary"].alias("summary"), F.col("m.bookmarks").alias("bookmarks"), F.col("content").alias("document"))


def ebook(spark: SparkSession, source: str, folder: str, options: Options = Options(kind="epub"), books: DataFrame | None = None) -> DataFrame:
    """Books of the pages of containers with the metadata they carry, their pixels worked on and divided if that is asked for.

    ``books`` (book_id, title, authors) overrules what containers say of themselves.
    """
    entries = read_archives(spark, source).where("error is null")
    pages = pages_of(entries)
    names = book_names(pages)
    infos = book_infos(entries, names, options)
    pages = pages.join(names, "src").drop("src")
    if options.work is not None:
        from quirefold.pixels.pages import worked_pages

        pages = worked_pages(pages, options.work)
    known = infos.select("book_id", "title", "authors", "series", "volume", "number", "summary")
    if books is not None:
        known = known.join(books.select("book_id"), "book_id", "left_anti").unionByName(books, allowMissingColumns=True)
    documents = infos.select("book_id", F.col("document").alias("content"))
    if options.divides:
        sizes = pages.select("book_id", "chapter", "chapter_ord", "page_ord", "path", F.octet_length("content").cast("long").alias("size"), F.lit(None).cast("string").alias("half"))
        limit = spark.range(1).select(shard_bytes(F.lit(options.shard_mib).cast("int"))).collect()[0][0]
        parts = split_books(sizes, "book_id", "path", "chapter", ["chapter_ord", "page_ord"], "size", "half", limit, options.batch or "auto").select("book_id", "chapter_ord", "page_ord", "tome", "tome_chapter")
        total = parts.groupBy("book_id").agg(F.max("tome").alias("tomes"))
        part_id = F.concat_ws("-", F.col("book_id"), F.format_string("%03d", F.col("tome").cast("int")))
        every = parts.select("book_id", "tome").distinct().join(total, "book_id")
        titled = every.join(known, "book_id", "left").withColumn("title", shard_title(F.coalesce("title", F.col("book_id")), F.col("tome"), F.col("tomes")))
        known = titled.withColumn("book_id", part_id).drop("tome", "tomes")
        documents = every.join(documents, "book_id").select(part_id.alias("book_id"), "content")
        pages = pages.drop("chapter").join(parts, ["book_id", "chapter_ord", "page_ord"]).withColumnRenamed("tome_chapter", "chapter").withColumn("book_id", part_id).drop("tome")
    if options.kind != "epub":
        return write_books(cbz_entries(pages, documents if options.keep_info else None), folder, options.kind)
    sized = pages.withColumn("size", image_size(F.col("content"))).select("book_id", "chapter", "chapter_ord", "page_ord", "path", "content", F.col("size.width").alias("width"), F.col("size.height").alias("height"))
    return write_books(epub_entries(sized, known, options.right_to_left), folder, "epub")


def navigation(pages: DataFrame, infos: DataFrame, delta: int = 1) -> DataFrame:
    """Bookmarks of each book with the name of the page they lead to after spreads were split: book_id, mark, image, title, page.

    ``pages`` has book_id, n (from 1, in reading order) and order_class.
    """
    classes = pages.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "order_class"))), lambda s: s["order_class"]).alias("classes"))
    moved = infos.join(classes, "book_id").select("book_id", F.posexplode(bookmark_targets(F.col("bookmarks"), F.col("classes"), delta)).alias("mark", "m"))
    return moved.select("book_id", "mark", "m.image", "m.title", page_name(F.col("m.image") + 1).alias("page"))


def is_page(path: Column) -> Column:
    """Whether a file can be a page of a book."""
    return media_type(extension_of(path)).isNotNull()
