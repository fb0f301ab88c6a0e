"""Assembling EPUB 3 books from pages: one frame of container entries, all text made by Spark expressions.

The layout of a book is ours: the package document lies beside a folder of pictures and one of
documents, the table of contents is a document among them.  What the specification prescribes is
the first entry, the container document, the namespaces and the names of properties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.layout import spine_property
from quirefold.functions.text import extension, group_position, html_escape, media_type, modified_stamp
from quirefold.operators.ordering import Ordered, number_rows

# Fixed values of the specification: the first entry, and where a reader looks for the package document.
MIMETYPE, CONTAINER_PATH, PACKAGE_PATH = "application/epub+zip", "META-INF/container.xml", "EPUB/package.opf"
_XML = '<?xml version="1.0" encoding="utf-8"?>\n'
_CONTAINER = f"""{_XML}<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0">
  <rootfiles><rootfile full-path="{PACKAGE_PATH}" media-type="application/oebps-package+xml"/></rootfiles>
</container>
"""
_LOOK = "html, body { height: 100%; margin: 0; }\nbody { display: flex; align-items: center; justify-content: center; background: #fff; }\n.sheet { max-width: 100%; max-height: 100%; object-fit: contain; }\n"


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _tag(name: str, value: Column, attributes: str = "") -> Column:
    """An element of one line; nothing for null and empty values."""
    full = F.concat(F.lit(f"    <{name}{attributes}>"), html_escape(value), F.lit(f"</{name}>\n"))
    return F.when(F.coalesce(value, F.lit("")) != "", full).otherwise("")


def epub_entries(pages: DataFrame, books: DataFrame, right_to_left: bool = False, family: str = "kobo") -> DataFrame:
    """Entries (book_id, entry_ord, name, content) of one EPUB per book, the mimetype first.

    ``pages`` has book_id, chapter, chapter_ord, page_ord, path, width, height and content; ``books`` has
    book_id, title and authors, and may have series, volume, number, summary and modified.  Books
    without a row are titled by their id; pages whose extension is no page image are left out.  Names
    follow the reading order; each chapter's first page is its entry in the table of contents, and the
    first page of all is the cover.  Page bytes are only copied: they go through no sort or window.
    The package document holds a few lines a page, so a book is as large as a reader could open.
    """
    known = pages.withColumn("media", media_type(extension(F.col("path")))).where("media is not null")
    order = ["chapter_ord", "page_ord", "path"]
    placed = Ordered(known.select("book_id", *order, "chapter", "media", "width", "height"), ["book_id"], order).number("n").before("prior", "chapter").frame()
    kept = placed.withColumn("opens", (F.col("n") == 1) | ~F.col("chapter").eqNullSafe(F.col("prior")))
    kept = kept.withColumn("key", F.format_string("%05d", F.col("n"))).withColumn("picture", F.concat(F.lit("pictures/"), "key", F.lit("."), extension(F.col("path")))).withColumn("document", F.concat(F.lit("sheets/"), "key", F.lit(".xhtml")))

    fields = {f.name for f in books.schema}
    info_of = F.struct("title", "authors", *[(F.col(c) if c in fields else F.lit(None).cast("string")).alias(c) for c in ("series", "volume", "number", "summary")], (F.col("modified") if "modified" in fields else F.timestamp_seconds(F.lit(0))).alias("modified"))
    info = books.groupBy("book_id").agg(F.max_by(info_of, "title").alias("m"))
    titled = kept.join(info, "book_id", "left").withColumn("title", F.coalesce("m.title", F.col("book_id")))
    label = html_escape(F.coalesce(F.nullif(F.col("chapter"), F.lit("")), F.col("title")))
    side = F.when(F.pmod("n", F.lit(2)) == (1 if right_to_left else 0), "right").otherwise("left")
    line = F.struct(
        "n",
        F.format_string('    <item id="sheet-%s" href="%s" media-type="application/xhtml+xml"/>\n', "key", "document").alias("sheet"),
        F.format_string('    <item id="picture-%s" href="%s" media-type="%s"%s/>\n', F.col("key"), F.col("picture"), F.col("media"), F.when(F.col("n") == 1, ' properties="cover-image"').otherwise("")).alias("picture"),
        F.format_string('    <itemref idref="sheet-%s" %s/>\n', F.col("key"), spine_property(side, family)).alias("place"),
        F.when(F.col("opens"), F.format_string('      <li><a href="%s">%s</a></li>\n', F.col("document"), label)).alias("entry"),
    )
    book = titled.select("book_id", "title", "m", line.alias("r")).groupBy("book_id").agg(F.max("title").alias("title"), F.first("m", ignorenulls=True).alias("m"), F.array_sort(F.collect_list("r")).alias("rows"))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("rows", lambda r: r[field]), "")

    creators = F.array_join(F.transform(F.coalesce("m.authors", F.array(F.lit("cb"))), lambda a: _tag("dc:creator", a)), "")
    series = F.when(F.coalesce("m.series", F.lit("")) != "", F.concat(_tag("meta", F.col("m.series"), ' property="belongs-to-collection" id="series"'), _tag("meta", group_position(F.col("m.volume"), F.col("m.number")), ' refines="#series" property="group-position"'))).otherwise("")
    package = F.concat(
        F.lit(f'{_XML}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="book">\n  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n'),
        _tag("dc:identifier", F.col("book_id"), ' id="book"'), _tag("dc:title", F.col("title")), creators, F.lit("    <dc:language>en</dc:language>\n"), _tag("dc:description", F.col("m.summary")), series,
        _tag("meta", modified_stamp(F.coalesce("m.modified", F.timestamp_seconds(F.lit(0)))), ' property="dcterms:modified"'), F.lit('    <meta property="rendition:layout">pre-paginated</meta>\n  </metadata>\n  <manifest>\n'),
        F.lit('    <item id="contents" href="contents.xhtml" media-type="application/xhtml+xml" properties="nav"/>\n    <item id="look" href="look.css" media-type="text/css"/>\n'), joined("picture"), joined("sheet"),
        F.lit(f'  </manifest>\n  <spine page-progression-direction="{"rtl" if right_to_left else "ltr"}">\n'), joined("place"), F.lit("  </spine>\n</package>\n"),
    )
    contents = F.concat(
        F.lit(f'{_XML}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">\n  <head><title>'), html_escape(F.col("title")),
        F.lit('</title></head>\n  <body>\n    <nav epub:type="toc"><ol>\n'), joined("entry"), F.lit("    </ol></nav>\n  </body>\n</html>\n"),
    )
    view = F.format_string('<meta name="viewport" content="width=%d, height=%d"/>', "width", "height")
    sheet = F.concat(
        F.lit(f'{_XML}<html xmlns="http://www.w3.org/1999/xhtml">\n  <head><title>'), F.col("key"), F.lit('</title>'), F.coalesce(F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), view), F.lit("")),
        F.lit('<link rel="stylesheet" href="../look.css"/></head>\n  <body><img class="sheet" alt="" src="../'), F.col("picture"), F.lit('"/></body>\n</html>\n'),
    )

    def fixed(place: int, name: str, content: Column) -> DataFrame:
        return book.select("book_id", F.lit(place).cast("long").alias("entry_ord"), F.lit(name).alias("name"), _bytes(content).alias("content"))

    same = F.col("k.book_id").eqNullSafe(F.col("p.book_id"))
    for c in order:
        same = same & F.col(f"k.{c}").eqNullSafe(F.col(f"p.{c}"))
    pictures = kept.select("book_id", *order, "n", "picture").alias("k").join(pages.select("book_id", *order, "content").alias("p"), same)
    parts = [
        fixed(0, "mimetype", F.lit(MIMETYPE)),
        fixed(1, CONTAINER_PATH, F.lit(_CONTAINER)),
        fixed(2, PACKAGE_PATH, package),
        fixed(3, "EPUB/contents.xhtml", contents),
        fixed(4, "EPUB/look.css", F.lit(_LOOK)),
        kept.select("book_id", (9 + 2 * F.col("n")).cast("long").alias("entry_ord"), F.concat(F.lit("EPUB/"), "document").alias("name"), _bytes(sheet).alias("content")),
        pictures.select("k.book_id", (10 + 2 * F.col("n")).cast("long").alias("entry_ord"), F.concat(F.lit("EPUB/"), "picture").alias("name"), "p.content"),
    ]
    return reduce(DataFrame.unionByName, parts)


def cbz_entries(pages: DataFrame, info: DataFrame | None = None, covers: DataFrame | None = None) -> DataFrame:
    """Entries (book_id, entry_ord, name, content) of a container of plain pages: the cover, ComicInfo.xml, then the pages in order.

    ``pages`` has book_id, chapter_ord, page_ord, path and content; ``info`` (book_id, content) is the
    metadata document to keep, ``covers`` (book_id, content) a picture that comes before all pages.
    """
    placed = number_rows(pages.select("book_id", "chapter_ord", "page_ord", "path"), ["book_id"], ["chapter_ord", "page_ord", "path"], "n")
    same = F.col("k.book_id").eqNullSafe(F.col("p.book_id")) & F.col("k.path").eqNullSafe(F.col("p.path")) & F.col("k.chapter_ord").eqNullSafe(F.col("p.chapter_ord")) & F.col("k.page_ord").eqNullSafe(F.col("p.page_ord"))
    body = placed.alias("k").join(pages.select("book_id", "chapter_ord", "page_ord", "path", "content").alias("p"), same)
    parts = [body.select("k.book_id", (F.col("n") + 2).cast("long").alias("entry_ord"), F.col("k.path").alias("name"), "content")]
    for place, name, extra in ((1, "##cover.jpg", covers), (2, "ComicInfo.xml", info)):
        if extra is not None:
            parts.append(extra.where("content is not null").groupBy("book_id").agg(F.min("content").alias("content")).select("book_id", F.lit(place).cast("long").alias("entry_ord"), F.lit(name).alias("name"), "content"))
    return reduce(DataFrame.unionByName, parts)
