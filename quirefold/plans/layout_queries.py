"""Queries over names, layouts and trees of folders, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import layout as L
from quirefold.functions import naming as N
from quirefold.functions import text as T
from quirefold.operators import trees
from quirefold.plans.reference_queries import _BASE, _ENC, _ENTRIES, _EXT, _FRAMED, _NORMAL, _PAGES, ENC_ORDER, PAGE_ORDER, _encoded, _entries, _framed, _normal_entries, _overlap_cte, _pack_cte, _pages
from quirefold.session import table

TARGET = 8 * 1024 * 1024


def _sides():
    """The frame's and the page's columns."""
    return F.col("W"), F.col("H"), F.col("width"), F.col("height")


def ref_strip_prefix(spark: SparkSession, d: str) -> DataFrame:
    e = _normal_entries(spark, d)
    roots = e.where(F.col("path").contains("/")).groupBy("src").agg(F.min(F.element_at(F.split("path", "/"), 1)).alias("root"))
    return e.join(roots, "src").select("entry_id", N.strip_prefix(F.col("path"), F.col("root")).alias("rest"), N.strip_prefix(F.col("path"), F.lit("")).alias("none"))


def ref_default_titles(spark: SparkSession, d: str) -> DataFrame:
    return _normal_entries(spark, d).select("entry_id", N.default_title(F.col("path"), F.col("folder")).alias("title"), T.word_name(F.col("path")).alias("word"), T.safe_join(F.lit("/shelf"), F.col("name")).alias("joined"))


def ref_output_names(spark: SparkSession, d: str) -> DataFrame:
    """Where converted containers and books of every source go."""
    e = _entries(spark, d).select("src").distinct().select(F.concat(F.lit("lib/"), "src").alias("source"), "src")
    no = F.lit(False)
    tome = F.lit(" 2")
    return e.select(
        "src", N.converted_name(F.col("source"), no, "cbt").alias("cbt"), N.converted_name(F.col("source"), no, "dir").alias("folder"), N.converted_name(F.col("source"), F.lit(True), "zip").alias("zipped"),
        N.already_in(sniffed(F.col("src")), "cbz").alias("is_zip"), N.already_in(sniffed(F.col("src")), "dir").alias("is_dir"),
        N.book_name(F.col("source"), no, "epub", tome, F.lit("")).alias("book"), N.book_name(F.col("source"), no, "kepub", tome, F.lit(None)).alias("kepub"),
        N.book_name(F.col("source"), no, "epub", F.lit(""), F.lit("out/x.epub")).alias("wanted"), N.book_name(F.col("source"), no, "cbz", tome, F.lit("out/")).alias("inside"),
    )


def sniffed(src):
    """Kind of a container by its name alone."""
    return T.archive_kind(T.extension(src))


def ref_part_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "encoded_pages").groupBy("enc_id").agg(*[F.max(c).alias(c) for c in ("chapter", "name", "order_class", "media_type")], F.max("flags.half").alias("half"))
    half = F.when(F.col("half").isin("above", "below"), F.col("half"))
    path = F.concat_ws("/", F.nullif(F.col("chapter"), F.lit("")), "name")
    return p.where("name is not null").select(
        "enc_id", N.part_name(path, F.col("media_type"), F.col("order_class"), half).alias("part"), N.part_name(path, F.col("media_type")).alias("plain"), N.unique_id(F.col("chapter"), F.col("name")).alias("unique_id"),
        N.below_id(N.unique_id(F.col("chapter"), F.concat(F.lit("above-"), "name"))).alias("below"), N.part_folder("Text", F.col("chapter")).alias("folder"), N.media_extension(F.col("media_type")).alias("ext"),
    )


def ref_order_letters(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in (*N.ORDER_LETTERS, "else")])
    return table(spark, d, "region").select("r_regionkey", F.explode(names).alias("place")).select("r_regionkey", "place", N.order_letter(F.col("place")).alias("letter"))


def ref_container_paths(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).where("name is not null")
    n = F.concat(F.element_at(F.array(F.lit("./"), F.lit("/"), F.lit("././/")), (F.col("entry_id") % 3 + 1).cast("int")), F.col("name"))
    return e.select("entry_id", N.container_path(n).alias("path"), N.dotted_extension(N.container_path(n)).alias("dotted"), T.resolve_relative(F.lit("OEBPS/Text"), F.concat(F.lit("../"), F.regexp_replace("name", r"\\", "/"))).alias("resolved"))


def ref_target_formats(spark: SparkSession, d: str) -> DataFrame:
    """Target spellings, one for each source and each known one."""
    e = _entries(spark, d).select(F.concat(F.lit(".."), F.upper(T.extension(F.col("src")))).alias("spelling")).unionByName(table(spark, d, "region").select(F.explode(F.array(*[F.lit(x) for x in (*T.ARCHIVE_KINDS, "dir", "pdf", "")])).alias("spelling")))
    return e.select("spelling", N.target_format(F.col("spelling")).alias("t")).groupBy("spelling", "t.extension", "t.kind").agg(F.count(F.lit(1)).alias("n"))


def ref_source_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    name = F.concat("name", F.when(F.col("entry_id") % 5 == 0, ".EPUB").when(F.col("entry_id") % 5 == 1, ".pdf").otherwise(""))
    return e.select("entry_id", N.source_kind(name, F.col("is_dir"), T.archive_kind(T.extension(F.col("src")))).alias("kind"))


def ref_byte_place(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return e.select("entry_id", N.byte_place(F.col("content"), b"WEBP").alias("webp"), N.byte_place(F.col("content"), b"\x00\x00").alias("zeros"))


def ref_number_formats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", T.thousands((F.col("o_totalprice") * 100).cast("long")).alias("grouped"), T.modified_stamp(F.col("o_orderdate").cast("timestamp")).alias("stamp"))


def ref_small_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Thumbnails, offsets of padded pages, covers and enlarged frames."""
    W, H, w, h = _sides()
    t, c, e = G.thumbnail_size(w, h, W, H), L.cover_size(W, H, limited=True), L.enlarged(W, H)
    return _framed(spark, d).select(
        "page_id", t["width"].alias("thumb_width"), t["height"].alias("thumb_height"), G.pad_offset(w, W).cast("long").alias("pad_x"), G.pad_offset(h, H).cast("long").alias("pad_y"),
        c["width"].alias("cover_width"), c["height"].alias("cover_height"), e["width"].alias("large_width"), e["height"].alias("large_height"),
    )


def ref_kept_crop(spark: SparkSession, d: str) -> DataFrame:
    """Crop boxes with a tenth of the margins kept, unless they leave less than four fifths of the page."""
    W, H, w, h = _sides()
    box = F.struct(F.floor(w / 40).alias("left"), F.floor(h / (8 + F.col("page_id") % 60)).alias("top"), (w - F.floor(w / 50)).alias("right"), (h - 7).alias("bottom"))
    return _framed(spark, d).select("page_id", L.kept_crop(box, w, h, 0.8, 10.0).alias("b")).select("page_id", "b.left", "b.top", "b.right", "b.bottom")


def ref_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Areas, unions and ranges of boxes made of pages and frames."""
    W, H, w, h = _sides()
    box = F.struct((w - W).alias("left"), (h - H).alias("top"), w.alias("right"), H.alias("bottom"))
    a = F.struct(F.lit(0).alias("x1"), w.alias("x2"), F.lit(0).alias("y1"), h.alias("y2"))
    b = F.struct((W + 5).alias("x1"), (W * 2).alias("x2"), F.lit(10).alias("y1"), H.alias("y2"))
    u, r = G.boxes_union(a, b), L.clipped(w - W, w + 50, W)
    return _framed(spark, d).select(
        "page_id", L.box_area(box).alias("area"), u["x2"].cast("long").alias("right"), u["y2"].cast("long").alias("bottom"), G.boxes_meet(a, b, 10.0, 0.0).alias("meet"), r["start"].alias("start"), r["stop"].alias("stop"),
        L.spread(w, W).cast("long").alias("spread"), L.is_degenerate(w, W).alias("degenerate"), G.palette_bits(F.pmod("page_id", F.lit(40))).alias("bits"),
    )


def ref_strip_pads(spark: SparkSession, d: str) -> DataFrame:
    W, H, w, h = _sides()
    p = _framed(spark, d)
    kept = G.kept_span(F.lit(0), h)
    return p.select("page_id", L.strip_pads(w).alias("s"), G.view_height(w, W, H).alias("view"), kept.alias("k")).select("page_id", F.col("s.v").alias("v"), F.col("s.h").alias("h"), F.col("s.step").alias("step"), "view", F.col("k.first").alias("first"), F.col("k.last").alias("last"))


def ref_render(spark: SparkSession, d: str) -> DataFrame:
    W, H, w, h = _sides()
    t = L.render_size(W, H, "margins")
    return _framed(spark, d).select("page_id", F.round(L.render_zoom(t, w, h), 9).alias("zoom"), F.round(L.render_zoom(t, w, h, by_width=True), 9).alias("zoom_width"), F.round(L.render_size(W, H, "numbers")["width"], 6).alias("target"))


def ref_panels(spark: SparkSession, d: str) -> DataFrame:
    """Regions of every page in the magnified view, for both reading directions."""
    W, H, w, h = _sides()
    p = _framed(spark, d)
    size, rotated = L.magnified(w, h, W, H), w > h
    out = None
    for rtl in (False, True):
        each = p.select("page_id", F.lit(rtl).alias("rtl"), L.panel_grid(size, W, H).alias("grid"), F.explode_outer(L.panel_regions(size, W, H, rotated, rtl)).alias("r")).select("page_id", "rtl", "grid", "r.id", "r.ordinal", "r.style")
        out = each if out is None else out.unionByName(each)
    return out


def ref_reading(spark: SparkSession, d: str) -> DataFrame:
    """Direction, opening side, writing mode and spine attributes for every source and combination of flags."""
    e = _entries(spark, d).select("src").distinct()
    flags = e.select("src", F.explode(F.array(*[F.struct(F.lit(a).alias("rtl"), F.lit(b).alias("inverted")) for a in (False, True) for b in (False, True)])).alias("f")).select("src", "f.*")
    way = L.direction(F.col("rtl"), F.col("inverted"))
    name = F.concat("src", F.when(F.col("inverted"), F.lit(".PDF")).otherwise(""))
    side = L.opening_side(way, name)
    return flags.select("src", "rtl", "inverted", way.alias("way"), side.alias("side"), L.opening_side(way, name, shifted=True).alias("shifted"), L.writing_mode(F.col("rtl"), way).alias("mode"), L.spine_property(side).alias("spine"), L.spine_property(L.opposite(side), "kobo").alias("other"))


def ref_frequencies(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    bin_ = F.pmod(F.col("o_orderkey"), F.lit(257)).cast("int")
    return o.select("o_orderkey", F.round(L.bin_frequency(bin_, 257), 9).alias("frequency"), L.on_diagonal(F.pmod(F.col("o_orderkey") * 7, F.lit(360)).cast("double")).alias("diagonal"), L.shard_bytes(F.nullif(bin_, F.lit(5))).alias("bytes"), L.shard_bytes(F.lit(None).cast("int"), strips=True).alias("strip_bytes"))


def ref_padding(spark: SparkSession, d: str) -> DataFrame:
    W, H, w, h = _sides()
    p = table(spark, d, "pages").groupBy("page_id").agg(F.max("background").alias("background"), F.max("width").alias("width"), F.max("height").alias("height"))
    c = L.padding_colour(F.when(F.col("page_id") % 4 == 0, "black"), F.col("background"))
    return p.select("page_id", c["colour"].alias("colour"), c["value"].alias("value"), L.clamp_measure("split", w, h).alias("pixels"), L.clamp_measure("max-width", w, h).alias("across"), G.threshold_from_power(F.pmod("page_id", F.lit(3)).cast("double")).alias("threshold"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _normal_entries(spark, d).where(~F.col("folder")).select("src", "path").withColumn("archive", T.extension(F.col("path")).isin(*T.ARCHIVE_KINDS))


def ref_folder_facts(spark: SparkSession, d: str) -> DataFrame:
    return trees.folder_facts(_files(spark, d), ["src"], "path", "archive").select("src", "folder", "has_images", "has_archives", "any_images", "image_folders", "standalone")


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """A library: the container of every source, and a folder for every book with its pages."""
    src = _entries(spark, d).select("src").distinct().select(F.concat(F.lit("lib/"), "src").alias("path"), F.lit(False).alias("is_dir"), sniffed(F.col("src")).alias("kind"))
    pages = _pages(spark, d).where("path is not null").select(F.concat_ws("/", F.lit("lib"), "book_id", "path").alias("path"), F.lit(False).alias("is_dir"), F.lit(None).cast("string").alias("kind"))
    books = _pages(spark, d).where("book_id is not null").select(F.concat(F.lit("lib/"), "book_id").alias("path"), F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("kind")).distinct()
    return src.unionByName(pages).unionByName(books)


def ref_convert_tasks(spark: SparkSession, d: str) -> DataFrame:
    listing = _listing(spark, d)
    facts = trees.folder_facts(listing.where(~F.col("is_dir")).withColumn("archive", F.col("kind").isNotNull()), [], "path", "archive")
    zip_, dir_ = (trees.convert_tasks(listing, facts, "lib", t).withColumn("target", F.lit(t)) for t in ("cbz", "dir"))
    return zip_.unionByName(dir_)


def ref_clamp_inputs(spark: SparkSession, d: str) -> DataFrame:
    return trees.clamp_inputs(_listing(spark, d), "lib", "lib/bk00000001")


def ref_sibling_covers(spark: SparkSession, d: str) -> DataFrame:
    src = _entries(spark, d).select("src").distinct().select(F.concat(F.lit("series/"), "src").alias("path"))
    covers = _pages(spark, d).where("book_id is not null").select(F.concat(F.lit("series/Covers/"), "book_id", F.lit(".jpg")).alias("path")).distinct()
    return trees.sibling_covers(src.unionByName(covers), "path")


def ref_nth_page(spark: SparkSession, d: str) -> DataFrame:
    return trees.nth_of(_pages(spark, d), ["book_id"], PAGE_ORDER, 3).select("book_id", "page_id")


def ref_merge_offsets(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return trees.merge_offsets(p.select("book_id", "chapter", "page_ord", "page_id", "height"), ["book_id", "chapter"], ["page_ord", "page_id"], "height", limit=2**40).select("page_id", "offset", "strip_height")


def ref_strip_pages(spark: SparkSession, d: str) -> DataFrame:
    """Virtual pages of 1,448 rows of the parts that strips are halved into."""
    W, H, w, h = _sides()
    p = _pages(spark, d).where("height > 0")
    parts = p.select("page_id", F.explode(G.overlap_parts(F.lit(0), h.cast("long"), 700)).alias("v")).select("page_id", "v.top", "v.bottom")
    return trees.strip_pages(parts, ["page_id"], "top", "bottom", 1448).select("page_id", "page", "top", "bottom", "n_panels", "rows")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Encoded pages; every third book has a folder above its chapters, and every seventh has one chapter at the root."""
    e = _encoded(spark, d).where("book_id is not null").withColumn("book", F.substring("book_id", 3, 20).cast("long"))
    base = F.when((F.col("book") % 7 == 0) & (F.col("chapter_ord") == 1), "").otherwise(F.when(F.col("book") % 3 == 0, F.concat(F.lit("Part "), (F.col("chapter_ord") % 3).cast("string"), F.lit("/"), "chapter")).otherwise(F.col("chapter")))
    return e.withColumn("chapter", F.coalesce(base, F.lit(""))).withColumn("path", F.concat_ws("/", F.nullif(F.col("chapter"), F.lit("")), F.col("enc_id").cast("string")))


def ref_split_modes(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d)
    auto = trees.split_modes(p, "book_id", "path", "chapter", "n_bytes", TARGET).withColumn("batch", F.lit("auto"))
    return auto.unionByName(trees.split_modes(p, "book_id", "path", "chapter", "n_bytes", TARGET, "folders").withColumn("batch", F.lit("folders")))


def ref_split_books(spark: SparkSession, d: str) -> DataFrame:
    """Every book in parts of at most 8 MiB, by pages, chapters or folders, as its folders ask for."""
    return trees.split_books(_parts(spark, d), "book_id", "path", "chapter", ENC_ORDER, "n_bytes", "half", TARGET).groupBy("book_id", "tome", "tome_chapter").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.coalesce("n_bytes", F.lit(0))).alias("bytes"))


QUERIES = {name: query for name, query in dict(globals()).items() if name.startswith("ref_")}

_TITLE = "regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_PARENT = "regexp_replace({0}, '(^|/)[^/]*$', '')"
_SRC = f"{_ENTRIES}, s AS (SELECT DISTINCT src, 'lib/' || src AS source FROM entries_once)"
_SRC_EXT = "lower(regexp_extract(src, '.\\.([^.]*)$', 1))"
_KIND = "CASE WHEN {0} IN ('zip', 'cbz') THEN 'zip' WHEN {0} IN ('rar', 'cbr') THEN 'rar' WHEN {0} IN ('7z', 'cb7') THEN '7z' WHEN {0} IN ('tar', 'cbt') THEN 'tar' WHEN {0} = 'dir' THEN 'dir' END"
_NAMED = "named AS (SELECT enc_id, max(chapter) AS chapter, max(name) AS name, max(order_class) AS order_class, max(media_type) AS media_type, max(flags.half) AS half FROM encoded_pages GROUP BY enc_id HAVING max(name) IS NOT NULL)"
_MEDIA = "CASE media_type WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'image/gif' THEN 'gif' WHEN 'image/webp' THEN 'webp' END"
_STEM = "regexp_replace(name, '(.)\\.[^.]*$', '\\1')"
_DIR = "CASE WHEN coalesce(chapter, '') = '' THEN '' ELSE chapter || '/' END"
_SW = "trunc(width * 1.5)"
_SH = "trunc(height * 1.5)"
_OFF = "CAST(trunc(trunc({0} / 2.0 - {1} / 2.0) / {0} * 100) AS BIGINT)"
_LISTING = f"{_ENTRIES}, {_PAGES}, listing AS (SELECT DISTINCT 'lib/' || src AS path, false AS is_dir, {_KIND.format(_SRC_EXT)} AS kind FROM entries_once UNION ALL SELECT CASE WHEN book_id IS NULL THEN 'lib/' || path ELSE 'lib/' || book_id || '/' || path END, false, NULL FROM pages_once WHERE path IS NOT NULL UNION ALL SELECT DISTINCT 'lib/' || book_id, true, NULL FROM pages_once WHERE book_id IS NOT NULL)"
_IMAGE_EXT = "('jpg', 'jpeg', 'png', 'gif', 'bmp', 'webp', 'tiff', 'tif', 'avif')"
_NATKEY_OF = "array_to_string(list_transform(regexp_extract_all(regexp_replace(lower({0}), '\\s+', '', 'g'), '([0-9]+|[^0-9]+)'), lambda t: CASE WHEN t[1] = '0' THEN '0' || t || chr(1) WHEN t[1] BETWEEN '1' AND '9' THEN '1' || lpad(CAST(length(t) AS VARCHAR), 4, '0') || t ELSE t END), '')"
_PARTS = f"{_ENC}, b0 AS (SELECT *, CAST(substr(book_id, 3) AS BIGINT) AS book FROM enc WHERE book_id IS NOT NULL), b1 AS (SELECT * REPLACE (coalesce(CASE WHEN book % 7 = 0 AND chapter_ord = 1 THEN '' WHEN book % 3 = 0 THEN 'Part ' || (chapter_ord % 3) || '/' || chapter ELSE chapter END, '') AS chapter) FROM b0), parts AS (SELECT *, CASE WHEN chapter = '' THEN CAST(enc_id AS VARCHAR) ELSE chapter || '/' || enc_id END AS path FROM b1), sizes AS (SELECT book_id, chapter, sum(coalesce(n_bytes, 0)) AS weight, min(len(string_split(path, '/'))) AS low, max(len(string_split(path, '/'))) AS high FROM parts GROUP BY ALL), facts AS (SELECT book_id, min(low) AS level, min(low) <> max(high) AS mixed, max(weight > {TARGET}) AS over FROM sizes GROUP BY book_id)"
_MODE = "CASE WHEN flatten OR level = 1 THEN 'pages' WHEN level >= 3 OR (batch = 'folders' AND level = 2) THEN 'folders' ELSE 'chapters' END AS mode"
_MODES = f"{_PARTS}, modes AS (SELECT *, {_MODE} FROM (SELECT *, mixed OR (batch = 'auto' AND level = 2 AND over) AS flatten FROM facts, (VALUES ('auto'), ('folders')) v(batch)))"
_RANKED = f"{_MODES.replace('b0 AS', 'b0 AS')}, m AS (SELECT p.*, mode, flatten, row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord, page_ord, sub_ord, enc_id) AS r FROM parts p JOIN modes USING (book_id) WHERE batch = 'auto')"

ORACLE = {
    "ref_strip_prefix": f"WITH {_NORMAL}, roots AS (SELECT src, min(string_split(path, '/')[1]) AS root FROM normal WHERE path LIKE '%/%' GROUP BY src) SELECT entry_id, CASE WHEN starts_with(path, root || '/') THEN nullif(substr(path, length(root) + 2), '') END AS rest, CAST(NULL AS VARCHAR) AS none FROM normal JOIN roots USING (src) WHERE path IS NOT NULL",
    "ref_default_titles": f"WITH {_NORMAL} SELECT entry_id, CASE WHEN folder THEN {_BASE} ELSE {_TITLE.format('path')} END AS title, regexp_replace(path, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}]+', '_', 'g') AS word, '/shelf/' || path AS joined FROM normal WHERE path IS NOT NULL",
    "ref_output_names": f"WITH {_SRC}, t AS (SELECT src, source, {_TITLE.format('source')} AS title, {_SRC_EXT} AS ext FROM s) SELECT src, 'lib/' || title || '.cbt' AS cbt, 'lib/' || title AS folder, 'lib/' || src || '.zip' AS zipped, coalesce(ext IN ('zip', 'cbz'), false) AS is_zip, false AS is_dir, 'lib/' || title || ' 2.epub' AS book, 'lib/' || regexp_replace(title, '\\W+', '_', 'g') || ' 2.kepub.epub' AS kepub, 'out/x.epub' AS wanted, 'out/' || title || ' 2.cbz' AS inside FROM t",
    "ref_part_names": f"WITH {_NAMED} SELECT enc_id, {_DIR} || {_STEM} || '-cb-' || order_class || CASE WHEN half IN ('above', 'below') THEN '-' || half ELSE '' END || '.' || {_MEDIA} AS part, {_DIR} || {_STEM} || '.' || {_MEDIA} AS plain, replace('Images/' || {_DIR} || {_STEM}, '/', '_') AS unique_id, replace(replace('Images/' || {_DIR} || 'above-' || {_STEM}, '/', '_'), 'above', 'below') AS below, CASE WHEN coalesce(chapter, '') = '' THEN 'Text' ELSE 'Text/' || chapter END AS folder, {_MEDIA} AS ext FROM named",
    "ref_order_letters": "SELECT r_regionkey, place, CASE place WHEN 'normal' THEN 'x' WHEN 'rotated_first' THEN 'a' WHEN 'rotated_last' THEN 'd' WHEN 'first_half' THEN 'b' WHEN 'second_half' THEN 'c' END AS letter FROM region, (VALUES ('normal'), ('rotated_first'), ('rotated_last'), ('first_half'), ('second_half'), ('else')) v(place)",
    "ref_container_paths": f"WITH RECURSIVE {_ENTRIES}, n AS (SELECT entry_id, name, regexp_replace(regexp_replace(replace(['./', '/', '././/'][entry_id % 3 + 1] || name, '\\', '/'), '^(\\./)+', ''), '^/+', '') AS path FROM entries_once WHERE name IS NOT NULL), p AS (SELECT entry_id, list_filter(string_split('../' || replace(name, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.') AS steps FROM n), r(entry_id, steps, out) AS (SELECT entry_id, steps, ['OEBPS', 'Text'] FROM p UNION ALL SELECT entry_id, steps[2:], CASE WHEN steps[1] = '..' THEN out[:len(out) - 1] ELSE list_append(out, steps[1]) END FROM r WHERE len(steps) > 0) SELECT n.entry_id, path, regexp_extract(regexp_extract(path, '([^/\\\\]*)$', 1), '.(\\.[^.]*)$', 1) AS dotted, array_to_string(out, '/') AS resolved FROM n JOIN r USING (entry_id) WHERE len(steps) = 0",
    "ref_target_formats": f"WITH {_ENTRIES}, t AS (SELECT '..' || upper({_SRC_EXT}) AS spelling FROM entries_once UNION ALL SELECT spelling FROM region, (VALUES ('zip'), ('cbz'), ('rar'), ('cbr'), ('7z'), ('cb7'), ('tar'), ('cbt'), ('dir'), ('pdf'), ('')) v(spelling)), k AS (SELECT spelling, lower(regexp_replace(spelling, '^\\.+', '')) AS bare FROM t) SELECT spelling, CASE WHEN {_KIND.format('bare')} IS NOT NULL THEN bare END AS extension, {_KIND.format('bare')} AS kind, count(*) AS n FROM k GROUP BY ALL",
    "ref_source_kinds": f"WITH {_ENTRIES} SELECT entry_id, CASE WHEN coalesce(is_dir, false) THEN 'dir' WHEN name IS NOT NULL AND entry_id % 5 = 0 THEN 'epub' WHEN name IS NOT NULL AND entry_id % 5 = 1 THEN 'pdf' ELSE {_KIND.format(_SRC_EXT)} END AS kind FROM entries_once",
    "ref_byte_place": f"WITH {_ENTRIES}, p AS (SELECT entry_id, content, ' ' || regexp_replace(hex(content), '(..)', '\\1 ', 'g') AS h FROM entries_once) SELECT entry_id, CASE WHEN content IS NOT NULL THEN CAST(CASE WHEN instr(h, ' 57 45 42 50') > 0 THEN (instr(h, ' 57 45 42 50') - 1) // 3 ELSE -1 END AS INT) END AS webp, CASE WHEN content IS NOT NULL THEN CAST(CASE WHEN instr(h, ' 00 00') > 0 THEN (instr(h, ' 00 00') - 1) // 3 ELSE -1 END AS INT) END AS zeros FROM p",
    "ref_number_formats": "SELECT o_orderkey, format('{:,}', CAST(trunc(o_totalprice * 100) AS BIGINT)) AS grouped, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders",
    "ref_small_sizes": f"WITH {_FRAMED}, c AS (SELECT *, width <= W AND height <= H AS fits, height * W >= H * width AS tall FROM framed) SELECT page_id, CAST(CASE WHEN fits THEN width WHEN tall THEN greatest(round(CAST(width AS DOUBLE) / height * H), 1) ELSE W END AS BIGINT) AS thumb_width, CAST(CASE WHEN fits THEN height WHEN tall THEN H ELSE greatest(round(CAST(height AS DOUBLE) / width * W), 1) END AS BIGINT) AS thumb_height, CAST(greatest(W - width, 0) // 2 AS BIGINT) AS pad_x, CAST(greatest(H - height, 0) // 2 AS BIGINT) AS pad_y, CAST(least(W, 1920) AS BIGINT) AS cover_width, CAST(least(H, 1920) AS BIGINT) AS cover_height, CAST(trunc(W * 1.5) AS BIGINT) AS large_width, CAST(trunc(H * 1.5) AS BIGINT) AS large_height FROM c",
    "ref_kept_crop": f"WITH {_FRAMED}, b AS (SELECT page_id, width, height, (width // 40) * 0.9::DOUBLE AS l, (height // (8 + page_id % 60)) * 0.9::DOUBLE AS t, (width - width // 50) + (width // 50) * (1.0 - 0.9::DOUBLE) AS r, (height - 7) + 7 * (1.0 - 0.9::DOUBLE) AS o FROM framed), k AS (SELECT *, (r - l) * (o - t) / (CAST(width AS DOUBLE) * height) >= 0.8 AS ok FROM b) SELECT page_id, CASE WHEN ok THEN CAST(round_even(l, 0) AS BIGINT) END AS left, CASE WHEN ok THEN CAST(round_even(t, 0) AS BIGINT) END AS top, CASE WHEN ok THEN CAST(round_even(r, 0) AS BIGINT) END AS right, CASE WHEN ok THEN CAST(round_even(o, 0) AS BIGINT) END AS bottom FROM k",
    "ref_boxes": f"WITH {_FRAMED} SELECT page_id, CAST(greatest(W, 0) AS BIGINT) * greatest(2 * H - height, 0) AS area, CAST(greatest(width, W * 2) AS BIGINT) AS right, CAST(greatest(height, H) AS BIGINT) AS bottom, width + 10 >= W + 5 AND height >= 10 AND H >= 0 AS meet, CAST(greatest(width - W, 0) AS BIGINT) AS start, CAST(greatest(greatest(width - W, 0), least(width + 50, W)) AS BIGINT) AS stop, CAST(greatest(W - width, 0) AS BIGINT) AS spread, W <= width AS degenerate, CASE WHEN page_id % 40 <= 2 THEN 1 WHEN page_id % 40 <= 4 THEN 2 WHEN page_id % 40 <= 16 THEN 4 ELSE 8 END AS bits FROM framed",
    "ref_strip_pads": f"WITH {_FRAMED}, b AS (SELECT *, CAST(width // 80 + (width // 80) % 2 AS BIGINT) AS pad FROM framed) SELECT page_id, CASE WHEN width >= 300 THEN pad END AS v, CASE WHEN width >= 300 THEN CAST(width // 20 AS BIGINT) END AS h, CASE WHEN width >= 300 THEN pad // 2 END AS step, CAST(trunc(CASE WHEN W > 1072 THEN CAST(H AS DOUBLE) / 1072 ELSE CAST(H AS DOUBLE) / W END * least(1072, W, width)) AS BIGINT) AS view, CAST(trunc(height * 0.02::DOUBLE) AS BIGINT) AS first, CAST(trunc(height - height * 0.02::DOUBLE) AS BIGINT) AS last FROM b",
    "ref_render": f"WITH {_FRAMED} SELECT page_id, round(H * 1.2::DOUBLE / height, 9) AS zoom, round(CASE WHEN width > height THEN H * 1.2::DOUBLE / height ELSE W * 1.2::DOUBLE / width END, 9) AS zoom_width, round(W * 1.25::DOUBLE, 6) AS target FROM framed",
    "ref_panels": f"""WITH {_FRAMED}, s AS (SELECT page_id, W, H, {_SW} AS sw, {_SH} AS sh, width > height AS rotated FROM framed), g AS (SELECT page_id, rotated, {_OFF.format('W', 'sw')} AS x, {_OFF.format('H', 'sh')} AS y, CASE WHEN sw - W < W * 0.01::DOUBLE AND sh - H < H * 0.01::DOUBLE THEN 'none' WHEN sw - W < W * 0.01::DOUBLE THEN 'stacked' WHEN sh - H < H * 0.01::DOUBLE THEN 'side' ELSE 'quadrants' END AS grid FROM s),
t AS (SELECT * FROM (VALUES ('quadrants', false, false, [1, 2, 3, 4]), ('quadrants', false, true, [2, 1, 4, 3]), ('quadrants', true, false, [2, 4, 1, 3]), ('quadrants', true, true, [1, 3, 2, 4]), ('stacked', false, false, [1, 2]), ('stacked', false, true, [1, 2]), ('stacked', true, false, [2, 1]), ('stacked', true, true, [1, 2]), ('side', false, false, [1, 2]), ('side', false, true, [2, 1]), ('side', true, false, [1, 2]), ('side', true, true, [1, 2]), ('none', false, false, [NULL]), ('none', false, true, [NULL]), ('none', true, false, [NULL]), ('none', true, true, [NULL])) v(grid, rotated, rtl, places)),
i AS (SELECT g.*, rtl, unnest(range(1, len(places) + 1)) AS k, unnest(places) AS ordinal FROM g JOIN t USING (grid, rotated)),
n AS (SELECT *, CASE grid WHEN 'quadrants' THEN ['PV-TL', 'PV-TR', 'PV-BL', 'PV-BR'][k] WHEN 'stacked' THEN ['PV-T', 'PV-B'][k] WHEN 'side' THEN ['PV-L', 'PV-R'][k] END AS id FROM i)
SELECT page_id, rtl, grid, id, ordinal, CASE id WHEN 'PV-TL' THEN 'position:absolute;left:0;top:0;' WHEN 'PV-TR' THEN 'position:absolute;right:0;top:0;' WHEN 'PV-BL' THEN 'position:absolute;left:0;bottom:0;' WHEN 'PV-BR' THEN 'position:absolute;right:0;bottom:0;' WHEN 'PV-T' THEN 'position:absolute;top:0;left:' || x || '%;' WHEN 'PV-B' THEN 'position:absolute;bottom:0;left:' || x || '%;' WHEN 'PV-L' THEN 'position:absolute;left:0;top:' || y || '%;' WHEN 'PV-R' THEN 'position:absolute;right:0;top:' || y || '%;' END AS style FROM n""",
    "ref_reading": f"WITH {_SRC}, f AS (SELECT src, rtl, inverted, CASE WHEN rtl <> inverted THEN 'rtl' ELSE 'ltr' END AS way FROM s, (VALUES (false), (true)) a(rtl), (VALUES (false), (true)) b(inverted)), o AS (SELECT *, CASE WHEN (way = 'rtl') <> (inverted OR {_SRC_EXT} IN ('pdf', 'epub')) THEN 'right' ELSE 'left' END AS side FROM f), p AS (SELECT *, CASE side WHEN 'left' THEN 'right' ELSE 'left' END AS shifted FROM o) SELECT src, rtl, inverted, way, side, shifted, CASE WHEN rtl THEN 'vertical' ELSE 'horizontal' END || CASE way WHEN 'rtl' THEN '-rl' ELSE '-lr' END AS mode, 'linear=\"yes\" properties=\"page-spread-' || side || '\"' AS spine, 'properties=\"rendition:page-spread-' || shifted || '\"' AS other FROM p",
    "ref_frequencies": "WITH o AS (SELECT o_orderkey, o_orderkey % 257 AS b, CAST(o_orderkey * 7 % 360 AS DOUBLE) AS a FROM orders) SELECT o_orderkey, round(CASE WHEN b <= 257 / 2.0 THEN b / 257.0::DOUBLE ELSE (b - 257) / 257.0::DOUBLE END, 9) AS frequency, (a BETWEEN 125 AND 145) OR (a BETWEEN 215 AND 235) OR (a BETWEEN 305 AND 325) OR (a BETWEEN 35 AND 55) AS diagonal, CAST(CASE WHEN b = 5 THEN 400 ELSE b END AS BIGINT) * 1048576 AS bytes, CAST(100 * 1048576 AS BIGINT) AS strip_bytes FROM o",
    "ref_padding": "WITH p AS (SELECT page_id, max(background) AS background, max(width) AS width, max(height) AS height FROM pages GROUP BY page_id), c AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN 'black' ELSE coalesce(background, 'white') END AS colour FROM p) SELECT page_id, colour, CASE colour WHEN 'black' THEN 0 ELSE 255 END AS value, CAST(width AS BIGINT) * height AS pixels, CAST(width AS BIGINT) AS across, CAST(240 - 64 * (page_id % 3) AS DOUBLE) AS threshold FROM c",
    "ref_folder_facts": f"WITH {_NORMAL}, f AS (SELECT src, path, {_EXT} IN {_IMAGE_EXT} AS image, {_EXT} IN ('zip', 'cbz', 'rar', 'cbr', '7z', 'cb7', 'tar', 'cbt') AS archive, string_split(path, '/') AS steps FROM normal WHERE NOT folder AND path IS NOT NULL), e AS (SELECT *, unnest(range(0, len(steps))) AS n FROM f), x AS (SELECT src, array_to_string(steps[1:n], '/') AS folder, image, archive, n = len(steps) - 1 AS direct, steps[n + 1] AS child FROM e), g AS (SELECT src, folder, bool_or(image AND direct) AS has_images, bool_or(archive AND direct) AS has_archives, bool_or(image) AS any_images, count(DISTINCT CASE WHEN image AND NOT direct THEN child END) AS image_folders FROM x GROUP BY src, folder) SELECT *, has_images OR (any_images AND NOT has_archives AND image_folders <= 1) AS standalone FROM g",
    "ref_convert_tasks": f"WITH {_LISTING}, here AS (SELECT * FROM listing WHERE {_PARENT.format('path')} = 'lib'), im AS (SELECT DISTINCT 'lib/' || string_split(path, '/')[2] AS path FROM listing WHERE NOT is_dir AND len(string_split(path, '/')) > 2 AND {_EXT} IN {_IMAGE_EXT}), z AS (SELECT here.path AS source, CASE WHEN is_dir THEN 'dir' ELSE kind END AS kind, is_dir, im.path IS NOT NULL AS has FROM here LEFT JOIN im USING (path)) SELECT source, kind, CASE WHEN is_dir THEN source ELSE {_PARENT.format('source')} || '/' || {_TITLE.format('source')} END || '.cbz' AS destination, kind = 'zip' AS skipped, 'cbz' AS target FROM z WHERE (NOT is_dir AND kind IS NOT NULL) OR (is_dir AND has) UNION ALL SELECT source, kind, {_PARENT.format('source')} || '/' || {_TITLE.format('source')}, false, 'dir' FROM z WHERE NOT is_dir AND kind IS NOT NULL",
    "ref_clamp_inputs": f"WITH {_LISTING} SELECT path, CASE WHEN is_dir THEN 'dir' ELSE kind END AS kind FROM listing WHERE {_PARENT.format('path')} = 'lib' AND path <> 'lib/bk00000001' AND (is_dir OR kind IS NOT NULL)",
    "ref_sibling_covers": f"WITH {_SRC}, {_PAGES}, c AS (SELECT cover, row_number() OVER (ORDER BY {_NATKEY_OF.format('b')}, cover) AS place FROM (SELECT DISTINCT book_id || '.jpg' AS b, 'series/Covers/' || book_id || '.jpg' AS cover FROM pages_once WHERE book_id IS NOT NULL)), o AS (SELECT 'series/' || src AS source, row_number() OVER (PARTITION BY {_SRC_EXT} ORDER BY {_NATKEY_OF.format('src')}, src) AS place FROM s) SELECT source, cover FROM o JOIN c USING (place)",
    "ref_nth_page": f"WITH {_PAGES} SELECT book_id, page_id FROM (SELECT book_id, page_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord NULLS FIRST, page_ord NULLS FIRST, page_id) AS r FROM pages_once) WHERE r = 3",
    "ref_merge_offsets": f"WITH {_PAGES} SELECT page_id, CAST(sum(coalesce(height, 0)) OVER (PARTITION BY book_id, chapter ORDER BY page_ord NULLS FIRST, page_id ROWS UNBOUNDED PRECEDING) - coalesce(height, 0) AS BIGINT) AS offset, CAST(sum(coalesce(height, 0)) OVER (PARTITION BY book_id, chapter) AS BIGINT) AS strip_height FROM pages_once",
    "ref_strip_pages": f"WITH RECURSIVE {_PAGES}, {_overlap_cte(700)}, o AS (SELECT page_id, CAST(top AS BIGINT) AS top, CAST(bottom AS BIGINT) AS bottom, CAST(bottom - top AS BIGINT) AS rows, row_number() OVER (PARTITION BY page_id ORDER BY top) AS k FROM p), s(page_id, k, page, room) AS (SELECT page_id, k, CAST(0 AS BIGINT), 1448 - rows FROM o WHERE k = 1 UNION ALL SELECT o.page_id, o.k, CASE WHEN s.room - o.rows > 0 THEN s.page ELSE s.page + 1 END, CASE WHEN s.room - o.rows > 0 THEN s.room - o.rows ELSE 1448 - o.rows END FROM s JOIN o ON o.page_id = s.page_id AND o.k = s.k + 1), g AS (SELECT page_id, page AS v, min(top) AS top, max(bottom) AS bottom, count(*) AS n_panels, CAST(sum(rows) AS BIGINT) AS rows FROM s JOIN o USING (page_id, k) GROUP BY ALL HAVING sum(rows) > 15) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY v) AS page, top, bottom, n_panels, rows FROM g",
    "ref_split_modes": f"WITH {_MODES} SELECT book_id, CAST(level AS INT) AS level, mixed, CASE WHEN batch = 'auto' AND level = 2 THEN over ELSE over END AS over, flatten, mode, batch FROM modes",
    "ref_split_books": f"""WITH RECURSIVE {_RANKED},
u0 AS (SELECT *, CASE WHEN half = 'below' AND lag(half) OVER (PARTITION BY book_id ORDER BY r) = 'above' THEN 0 ELSE 1 END AS opens FROM m WHERE mode = 'pages'), u AS (SELECT *, sum(opens) OVER (PARTITION BY book_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS unit FROM u0),
c0 AS (SELECT book_id, chapter, sum(coalesce(n_bytes, 0)) AS size, min(chapter_ord) AS place, any_value(mode) AS mode FROM m WHERE mode <> 'pages' GROUP BY book_id, chapter), c AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY place, chapter) AS k FROM c0),
items AS (SELECT book_id AS g, unit AS k, CAST(sum(coalesce(n_bytes, 0)) AS BIGINT) AS size FROM u GROUP BY ALL UNION ALL SELECT book_id, k, CAST(size AS BIGINT) FROM c WHERE mode = 'chapters'), {_pack_cte('items', TARGET)},
f0 AS (SELECT *, string_split(chapter, '/')[1] AS top FROM c WHERE mode = 'folders'), f1 AS (SELECT *, CASE WHEN top = lag(top) OVER (PARTITION BY book_id ORDER BY k) THEN 0 ELSE 1 END AS opens FROM f0), f AS (SELECT book_id, chapter, sum(opens) OVER (PARTITION BY book_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS tome FROM f1),
first AS (SELECT book_id, CASE WHEN any_value(flatten) THEN '' ELSE arg_min(chapter, r) END AS tome_chapter FROM m WHERE mode = 'pages' GROUP BY book_id),
a AS (SELECT u.book_id, shard + 1 AS tome, tome_chapter, n_bytes FROM u JOIN packed ON g = u.book_id AND packed.k = unit JOIN first USING (book_id) UNION ALL SELECT m.book_id, shard + 1, chapter, n_bytes FROM m JOIN c USING (book_id, chapter) JOIN packed ON g = m.book_id AND packed.k = c.k WHERE m.mode = 'chapters' UNION ALL SELECT m.book_id, f.tome, chapter, n_bytes FROM m JOIN f USING (book_id, chapter) WHERE m.mode = 'folders')
SELECT book_id, CAST(tome AS BIGINT) AS tome, tome_chapter, count(*) AS n_pages, CAST(sum(coalesce(n_bytes, 0)) AS BIGINT) AS bytes FROM a GROUP BY ALL""",
}
