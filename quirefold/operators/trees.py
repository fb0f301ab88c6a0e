"""Folders and chapters as wholes: what lies below a folder, which inputs a job has, how a book is divided.

Files are rows of paths; a folder is whatever stands before a slash.  Facts about folders are
aggregates over the folders above each file, so no tree is walked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.layout import LOWEST_PAGE, TALLEST_STRIP
from quirefold.functions.naming import already_in, converted_name
from quirefold.functions.text import base_name, depth, extension, is_book_image, is_image, natural_key, parent
from quirefold.operators.folds import greedy_pack, pack_heights, pack_units
from quirefold.operators.grouping import first_of, folder_prefixes
from quirefold.operators.ordering import Ordered, runs


def folder_facts(files: DataFrame, keys: Sequence[str], path: str, is_archive: str) -> DataFrame:
    """Every folder that has something below it: keys, folder, has_images, has_archives (both in it), any_images (at any depth), image_folders, standalone.

    image_folders counts the folders in it that have images at any depth.  A folder is one comic
    (standalone) if it has images, or else has some below it, no archives, and at most one such folder.
    The root is the empty folder.
    """
    p = F.col(path)
    marked = files.where(p.isNotNull()).select(*keys, p.alias("p"), is_image(p).alias("image"), F.coalesce(F.col(is_archive), F.lit(False)).alias("archive"))
    above = F.concat(F.array(F.lit("")), F.when(F.contains("p", F.lit("/")), folder_prefixes(F.col("p"))).otherwise(F.array().cast("array<string>")))
    each = marked.select("*", F.explode(above).alias("folder"))
    direct = parent(F.col("p")) == F.col("folder")
    rest = F.when(F.col("folder") == "", F.col("p")).otherwise(F.expr("substring(p, length(folder) + 2)"))
    child = F.when(F.col("image") & ~direct, F.element_at(F.split(rest, "/"), 1))
    # Children first, so that a folder with very many files is not one group of distinct names.
    by_child = each.groupBy(*keys, "folder", child.alias("child")).agg(F.max(F.col("image") & direct).alias("i"), F.max(F.col("archive") & direct).alias("a"), F.max("image").alias("any"))
    facts = by_child.groupBy(*keys, "folder").agg(F.max("i").alias("has_images"), F.max("a").alias("has_archives"), F.max("any").alias("any_images"), F.count("child").alias("image_folders"))
    one = F.col("has_images") | (F.col("any_images") & ~F.col("has_archives") & (F.col("image_folders") <= 1))
    return facts.withColumn("standalone", one)


def convert_tasks(listing: DataFrame, facts: DataFrame, folder: str, target: str) -> DataFrame:
    """What there is to convert in a folder: (source, kind, destination, skipped), in natural order of the names.

    ``listing`` has path, is_dir and kind (null for what is no container) of all below the folder, and
    ``facts`` are those of ``folder_facts`` without keys.  A folder that is one comic is itself the task;
    else its containers are, and for other targets than folders also the folders in it that have images.
    Containers that are in the target format already come back as skipped.
    """
    here = F.col("path").isNotNull() & (parent(F.col("path")) == folder) & (F.col("path") != folder)
    own = facts.where(F.col("folder") == folder)
    below = facts.where("any_images").select(F.col("folder").alias("path")).withColumn("has", F.lit(True))
    inside = listing.where(here).join(below, "path", "left")
    use = F.col("kind").isNotNull() & ~F.col("is_dir") if target == "dir" else (F.col("kind").isNotNull() & ~F.col("is_dir")) | (F.col("is_dir") & F.col("has"))
    kind = F.when(F.col("is_dir"), "dir").otherwise(F.col("kind"))
    each = inside.where(use).select(F.col("path").alias("source"), kind.alias("kind"), "is_dir")
    if target == "dir":
        each = each.join(own.where("has_archives").select(F.lit(1).alias("_")).limit(1), F.lit(True), "left_semi")
    else:
        alone = own.where("standalone")
        whole = alone.select(F.lit(folder).alias("source"), F.lit("dir").alias("kind"), F.lit(True).alias("is_dir"))
        each = each.join(alone.select(F.lit(1).alias("_")).limit(1), F.lit(True), "left_anti").unionByName(whole)
    done = each.select("source", "kind", converted_name(F.col("source"), F.col("is_dir"), target).alias("destination"), already_in(F.col("kind"), target).alias("skipped"))
    return done.orderBy(natural_key(base_name(F.col("source")), fold_case=False), "source")


def clamp_inputs(listing: DataFrame, folder: str, output: str) -> DataFrame:
    """Containers and folders directly in a folder, but for the output: (path, kind), in natural order of the names."""
    here = (parent(F.col("path")) == folder) & (F.col("path") != output) & (F.col("kind").isNotNull() | F.col("is_dir"))
    found = listing.where(here).select("path", F.when(F.col("is_dir"), "dir").otherwise(F.col("kind")).alias("kind"))
    return found.orderBy(natural_key(base_name(F.col("path")), fold_case=False), "path")


def sibling_covers(files: DataFrame, path: str, covers: str = "Covers") -> DataFrame:
    """The cover beside each file: the k-th image of the folder ``Covers`` next to it, for the k-th of its siblings of the same extension.

    Returns (source, cover); files of folders without covers, and those after the last cover, are missing.
    """
    p = F.col(path)
    rows = files.where(p.isNotNull()).select(p.alias("source"), parent(p).alias("folder"), extension(p).alias("ext"), natural_key(base_name(p)).alias("natkey"))
    is_cover = (base_name(F.col("folder")) == covers) & (is_book_image(F.col("source")))
    found = rows.where(is_cover).withColumn("beside", parent(F.col("folder")))
    ranked = Ordered(found, ["beside"], ["natkey", "source"]).number("place").frame().select("beside", "place", F.col("source").alias("cover"))
    mine = rows.join(found.select("beside").distinct(), rows["folder"] == F.col("beside"), "left_semi")
    siblings = Ordered(mine, ["folder", "ext"], ["natkey", "source"]).number("place").frame()
    return siblings.join(ranked.withColumnRenamed("beside", "folder"), ["folder", "place"]).select("source", "cover")


def nth_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n-th row (from 1) of each group; groups with fewer have none."""
    return Ordered(df, keys, order).number("_n").frame().where(F.col("_n") == n).drop("_n")


def merge_offsets(pages: DataFrame, keys: Sequence[str], order: Sequence[str], height: str, limit: int = TALLEST_STRIP) -> DataFrame:
    """Where each page begins in the strip of its group: adds ``offset`` and ``strip_height``; a strip over the limit is an error.

    Null heights count as 0.
    """
    tall = F.coalesce(F.col(height), F.lit(0)).cast("long")
    total = pages.groupBy(*keys).agg(F.sum(tall).alias("strip_height"))
    total = total.withColumn("strip_height", F.when(F.col("strip_height") > limit, F.raise_error(F.format_string("strip is too tall: %d rows", "strip_height"))).otherwise(F.col("strip_height")))
    summed = Ordered(pages, keys, order).sums(offset=tall).frame().withColumn("offset", F.col("offset") - tall)
    right = total.select(*[F.col(k).alias(f"_{k}") for k in keys], "strip_height")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return summed.join(right, same).drop(*[f"_{k}" for k in keys])


def strip_pages(parts: DataFrame, keys: Sequence[str], top: str, bottom: str, view: int) -> DataFrame:
    """Virtual pages of the panels of a strip: keys, page (from 1), top, bottom, n_panels, rows.

    Panels are taken in order while they leave room on the page; pages of hardly any rows are dropped
    and those after them move up.
    """
    sized = parts.withColumn("_rows", F.col(bottom) - F.col(top))
    packed = pack_heights(sized.select(*keys, top, bottom, "_rows"), keys, [top], "_rows", view)
    pages = packed.groupBy(*keys, "virtual_page").agg(F.min(top).alias("top"), F.max(bottom).alias("bottom"), F.count(F.lit(1)).alias("n_panels"), F.sum("_rows").alias("rows")).where(F.col("rows") > LOWEST_PAGE)
    return Ordered(pages, keys, ["virtual_page"]).number("page").frame().drop("virtual_page")


def split_modes(pages: DataFrame, book: str, path: str, chapter: str, size: str, target: int, batch: str = "auto") -> DataFrame:
    """How each book is divided: (book, level, mixed, over, flatten, mode), mode being pages, chapters or folders.

    Books whose pages lie at several depths are flattened and divided by pages, as are those of one level
    of folders with a chapter over the target (``auto``); ``folders`` divides those by folder.  Deeper
    books have a part for each top folder.
    """
    weight = F.sum(F.coalesce(F.col(size), F.lit(0))).alias("weight")
    deep = depth(F.col(path))
    by_chapter = pages.groupBy(book, chapter).agg(weight, F.min(deep).alias("low"), F.max(deep).alias("high"))
    facts = by_chapter.groupBy(book).agg(F.min("low").alias("level"), (F.min("low") != F.max("high")).alias("mixed"), F.max(F.col("weight") > target).alias("over"))
    over = F.lit(batch == "auto") & (F.col("level") == 2) & F.col("over")
    flatten = F.col("mixed") | over
    by_folder = (F.col("level") >= 3) | (F.lit(batch == "folders") & (F.col("level") == 2))
    mode = F.when(flatten | (F.col("level") == 1), "pages").when(by_folder, "folders").otherwise("chapters")
    return facts.select(book, "level", "mixed", "over", flatten.alias("flatten"), mode.alias("mode"))


def flatten_chapters(pages: DataFrame, path: str, chapter: str) -> DataFrame:
    """Pages without their folders, all in the root chapter; their order stays."""
    return pages.withColumn(path, base_name(F.col(path))).withColumn(chapter, F.lit(""))


def split_books(pages: DataFrame, book: str, path: str, chapter: str, order: Sequence[str], size: str, half: str, target: int, batch: str = "auto") -> DataFrame:
    """Pages with the part of their book they go to (``tome``, from 1) and the chapter they have there (``tome_chapter``).

    By pages, upper and lower halves stay together and all parts keep the name of the first chapter, or
    that of the root where the book was flattened; by chapters, whole chapters are packed in order; by
    folders, each run of chapters of one top folder is a part.  ``order`` begins with the chapter's place.
    """
    modes = split_modes(pages, book, path, chapter, size, target, batch).select(F.col(book).alias("_book"), "flatten", "mode")
    marked = pages.join(modes, F.col(book).eqNullSafe(F.col("_book"))).drop("_book")

    first = first_of(marked.where("mode = 'pages'"), [book], order, [chapter, "flatten"])
    name = first.select(F.col(book).alias("_book"), F.when(F.col("flatten"), "").otherwise(F.col(chapter)).alias("tome_chapter"))
    units = pack_units(marked.where("mode = 'pages'").select(book, *order, size, half), [book], order, size, half, target)
    by_pages = units.join(name, F.col(book).eqNullSafe(F.col("_book"))).select(book, *order, (F.col("shard") + 1).alias("tome"), "tome_chapter")

    chapters = marked.where("mode = 'chapters'").groupBy(book, chapter).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).cast("long").alias("weight"), F.min(order[0]).alias("place"))
    packed = greedy_pack(chapters, [book], ["place", chapter], "weight", target).select(book, chapter, (F.col("shard") + 1).alias("tome"))
    tops = marked.where("mode = 'folders'").groupBy(book, chapter).agg(F.min(order[0]).alias("place")).withColumn("top", F.element_at(F.split(F.coalesce(F.col(chapter), F.lit("")), "/"), 1))
    grouped = runs(tops, [book], ["place", chapter], "top").select(book, chapter, (F.col("run") + 1).alias("tome"))
    whole = packed.unionByName(grouped).select(F.col(book).alias("_book"), F.col(chapter).alias("_chapter"), "tome")
    rest = marked.where("mode <> 'pages'").join(whole, F.col(book).eqNullSafe(F.col("_book")) & F.col(chapter).eqNullSafe(F.col("_chapter")))
    by_chapters = rest.select(book, *order, "tome", F.col(chapter).alias("tome_chapter"))
    placed = by_pages.unionByName(by_chapters).select(F.col(book).alias("_book"), *[F.col(o).alias(f"_{o}") for o in order], "tome", "tome_chapter")
    same = F.col(book).eqNullSafe(F.col("_book"))
    for o in order:
        same = same & F.col(o).eqNullSafe(F.col(f"_{o}"))
    return pages.join(placed, same).drop("_book", *[f"_{o}" for o in order])
