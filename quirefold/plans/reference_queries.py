"""Queries over the page, entry and metadata tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import geometry as G
from quirefold.functions import layout as L
from quirefold.functions import text as T
from quirefold.operators import folds, grids, grouping
from quirefold.operators.ordering import Ordered
from quirefold.session import table
from quirefold.sources.archives import sniff_kind
from quirefold.sources.headers import image_size

PAGE_ORDER = ("chapter_ord", "page_ord", "page_id")
ENC_ORDER = ("chapter_ord", "page_ord", "sub_ord", "enc_id")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entries").groupBy("entry_id").agg(*[F.max(c).alias(c) for c in ("src", "kind", "pos", "name", "is_dir", "content")])


def _pages(spark: SparkSession, d: str) -> DataFrame:
    cols = ("book_id", "profile", "path", "chapter", "chapter_ord", "page_ord", "width", "height", "media_type", "n_bytes")
    return table(spark, d, "pages").groupBy("page_id").agg(*[F.max(c).alias(c) for c in cols])


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    cols = ("book_id", "profile", "chapter", "chapter_ord", "page_ord", "sub_ord", "name", "order_class", "width", "height", "n_bytes")
    return table(spark, d, "encoded_pages").groupBy("enc_id").agg(*[F.max(c).alias(c) for c in cols], F.max("flags.half").alias("half"))


def _comics(spark: SparkSession, d: str) -> DataFrame:
    cols = ("book_id", "series", "volume", "number", "title", "writers", "pencillers", "inkers", "colorists")
    return table(spark, d, "comicinfo").groupBy("info_id").agg(*[F.max(c).alias(c) for c in cols])


_ENTRIES = "entries_once AS (SELECT entry_id, max(src) AS src, max(kind) AS kind, max(pos) AS pos, max(name) AS name, max(is_dir) AS is_dir, max(content) AS content FROM entries GROUP BY entry_id)"
_PAGES = "pages_once AS (SELECT page_id, max(book_id) AS book_id, max(profile) AS profile, max(path) AS path, max(chapter) AS chapter, max(chapter_ord) AS chapter_ord, max(page_ord) AS page_ord, max(width) AS width, max(height) AS height, max(media_type) AS media_type, max(n_bytes) AS n_bytes FROM pages GROUP BY page_id)"
_ENC = "enc AS (SELECT enc_id, max(book_id) AS book_id, max(profile) AS profile, max(chapter) AS chapter, max(chapter_ord) AS chapter_ord, max(page_ord) AS page_ord, max(sub_ord) AS sub_ord, max(name) AS name, max(order_class) AS order_class, max(width) AS width, max(height) AS height, max(n_bytes) AS n_bytes, max(flags.half) AS half FROM encoded_pages GROUP BY enc_id)"
_COMICS = "comics AS (SELECT info_id, max(book_id) AS book_id, max(series) AS series, max(volume) AS volume, max(number) AS number, max(title) AS title, max(writers) AS writers, max(pencillers) AS pencillers, max(inkers) AS inkers, max(colorists) AS colorists FROM comicinfo GROUP BY info_id)"
_NORM = r"""nullif(array_to_string(list_filter(list_transform(list_filter(list_transform(string_split_regex(name, '[/\\]'), lambda p: regexp_replace(p, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda p: NOT (strlen(p) = 2 AND p LIKE '%:')), lambda p: regexp_replace(regexp_replace(p, ':+$', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda p: p NOT IN ('', '.', '..')), '/'), '')"""
_NATKEY = r"""array_to_string(list_transform(regexp_extract_all(regexp_replace(lower(name), '\s+', '', 'g'), '([0-9]+|[^0-9]+)'), lambda t: CASE WHEN t[1] = '0' THEN '0' || t || chr(1) WHEN t[1] BETWEEN '1' AND '9' THEN '1' || lpad(CAST(length(t) AS VARCHAR), 4, '0') || t ELSE t END), '')"""


def ref_normalize_path(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return e.select("entry_id", T.normalize_path(F.col("name")).alias("path"), T.is_directory(F.col("name"), F.col("is_dir")).alias("folder"))


def _normal_entries(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return e.withColumn("path", T.normalize_path(F.col("name"))).withColumn("folder", T.is_directory(F.col("name"), F.col("is_dir"))).where("path is not null")


def ref_path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _normal_entries(spark, d).select("entry_id", T.parent(p).alias("parent"), T.base_name(p).alias("base"), T.stem(p).alias("stem"), T.extension(p).alias("ext"), T.depth(p).alias("depth"))


def ref_image_filter(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    flags = _normal_entries(spark, d).where(~F.col("folder")).select("src", T.is_junk(p).alias("junk"), T.is_image(p).alias("image"), T.is_book_image(p).alias("page"), T.is_metadata(p).alias("meta"))
    return flags.groupBy("src").agg(F.count_if("junk").alias("n_junk"), F.count_if(F.col("image") & ~F.col("junk")).alias("n_images"), F.count_if(F.col("page") & ~F.col("junk")).alias("n_pages"), F.count_if(F.col("meta") & ~F.col("junk")).alias("n_meta"))


def ref_single_root(spark: SparkSession, d: str) -> DataFrame:
    return grouping.single_root(_normal_entries(spark, d), "src", "path", "folder")


def ref_matching_root(spark: SparkSession, d: str) -> DataFrame:
    roots = ref_single_root(spark, d).where("root is not null")
    titles = table(spark, d, "book_meta").where("book_id is not null").groupBy("book_id").agg(F.max("series").alias("series"))
    joined = roots.withColumn("book_id", F.regexp_extract("src", r"^(.*)\.[^.]*$", 1)).join(titles, "book_id", "left")
    return joined.select("src", "root", T.matches_root(F.col("root"), F.col("book_id"), F.col("series")).alias("matches"))


def ref_chapter_pages(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return p.groupBy("book_id", "chapter").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_bytes").alias("bytes"), F.min_by("page_id", F.struct("page_ord", "page_id")).alias("first_page"), F.max("page_ord").alias("last_ord"))


def ref_page_number(spark: SparkSession, d: str) -> DataFrame:
    numbered = grouping.number_rows(_pages(spark, d), ["book_id"], PAGE_ORDER)
    return numbered.select("page_id", "ordinal", T.page_name(F.col("ordinal")).alias("name"))


def ref_slug_pad(spark: SparkSession, d: str) -> DataFrame:
    c = _comics(spark, d).where("series is not null")
    return c.select("info_id", T.slug(F.col("series")).alias("slug"), T.pad_numbers(T.slug(F.col("series"))).alias("padded"))


def ref_natural_rank(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).where("name is not null").withColumn("natkey", T.natural_key(F.col("name")))
    return grouping.number_rows(e, ["src"], ["natkey", "name", "entry_id"], "rank").select("entry_id", "rank")


def ref_natural_sorted(spark: SparkSession, d: str) -> DataFrame:
    return grouping.natural_sorted(_entries(spark, d), ["src"], "name")


def ref_folder_order(spark: SparkSession, d: str) -> DataFrame:
    e = _normal_entries(spark, d).select("src", T.parent(F.col("path")).alias("dir")).distinct().withColumn("key", T.folder_key(F.col("dir")))
    return grouping.number_rows(e, ["src"], ["key", "dir"], "rank").select("src", "dir", "rank")


def ref_folder_prefixes(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).where("path like '%/%'")
    return p.select("book_id", F.explode(grouping.folder_prefixes(F.col("path"))).alias("folder")).groupBy("book_id", "folder").agg(F.count(F.lit(1)).alias("n_below"))


def ref_uniform_depth(spark: SparkSession, d: str) -> DataFrame:
    return grouping.uniform_depth(_pages(spark, d).where("path is not null"), ["book_id"], "path")


CAPACITY = 8 * 1024 * 1024


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return folds.greedy_pack(_encoded(spark, d).select("book_id", *ENC_ORDER, "n_bytes"), ["book_id"], ENC_ORDER, "n_bytes", CAPACITY)


def ref_greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each book in shards of at most 8 MiB, in reading order."""
    return _packed(spark, d).groupBy("book_id", "shard").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.coalesce("n_bytes", F.lit(0))).alias("bytes"))


def ref_shard_titles(spark: SparkSession, d: str) -> DataFrame:
    shards = ref_greedy_pack(spark, d)
    total = F.max("shard").over(Window.partitionBy("book_id")) + 1
    return shards.select("book_id", "shard", T.shard_title(F.col("book_id"), F.col("shard") + 1, total).alias("title"))


def ref_pack_pairs(spark: SparkSession, d: str) -> DataFrame:
    """As ref_greedy_pack, but the two halves of a tall page stay together."""
    packed = folds.pack_units(_encoded(spark, d).select("book_id", *ENC_ORDER, "n_bytes", "half"), ["book_id"], ENC_ORDER, "n_bytes", "half", CAPACITY)
    return packed.groupBy("book_id", "shard").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.coalesce("n_bytes", F.lit(0))).alias("bytes"))


def ref_pack_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Whole chapters of each book in shards of at most 32 MiB, in order."""
    sizes = _encoded(spark, d).groupBy("book_id", "chapter").agg(F.sum(F.coalesce("n_bytes", F.lit(0))).alias("bytes"), F.min("chapter_ord").alias("ord"))
    return folds.greedy_pack(sizes, ["book_id"], ["ord", "chapter"], "bytes", 4 * CAPACITY).select("book_id", "chapter", "bytes", "shard")


def ref_chapter_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of neighbouring pages of one chapter, in the order in which they arrived."""
    p = _pages(spark, d)
    marked = grouping.runs(p, ["book_id"], ["page_id"], "chapter")
    return marked.groupBy("book_id", "run").agg(F.max("chapter").alias("chapter"), F.count(F.lit(1)).alias("n_pages"))


def ref_event_runs(spark: SparkSession, d: str) -> DataFrame:
    marked = grouping.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return marked.groupBy("user_id", "run").agg(F.max("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


def _sides(spark: SparkSession, d: str, right_to_left: bool) -> DataFrame:
    whole = F.col("order_class") == "x"
    pages = Ordered(_encoded(spark, d).select("book_id", *ENC_ORDER, "order_class"), ["book_id"], ENC_ORDER)
    behind = pages.number("n").highest("pv", F.when(~whole, F.col("n") - 1)).frame().withColumn("i", F.col("n") - 1).withColumn("back", -F.col("i"))
    placed = Ordered(behind, ["book_id"], ["back"]).highest("nx", F.when(~whole, F.col("back"))).frame().withColumn("nx", -F.col("nx"))
    side = G.spread_side(F.col("order_class"), F.col("i"), F.col("nx"), F.col("pv"), right_to_left, "right" if right_to_left else "left")
    return placed.select("enc_id", side.alias("side"))


def ref_spread_sides(spark: SparkSession, d: str) -> DataFrame:
    return _sides(spark, d, False)


def ref_spread_sides_rtl(spark: SparkSession, d: str) -> DataFrame:
    return _sides(spark, d, True)


def ref_gap_groups(spark: SparkSession, d: str) -> DataFrame:
    """Activity of each user in minutes, grouped within 60 minutes."""
    minutes = table(spark, d, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("minute")).distinct()
    return folds.gap_groups(minutes, ["user_id"], "minute", 60)


def _bands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value is not null and user_id is not null")
    return e.withColumn("band", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)


def ref_panel_scan(spark: SparkSession, d: str) -> DataFrame:
    return grids.panels(_bands(spark, d), ["user_id"], "band", F.col("value") < 50, least=2, start=2)


def ref_pack_heights(spark: SparkSession, d: str) -> DataFrame:
    found = ref_panel_scan(spark, d).withColumn("tall", F.col("bottom") - F.col("top"))
    return folds.pack_heights(found, ["user_id"], ["top"], "tall", 8).select("user_id", "top", "bottom", "virtual_page")


def ref_overlap_parts(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).where("height > 0")
    return p.select("page_id", F.posexplode(G.overlap_parts(F.lit(0), F.col("height").cast("long"), 1400)).alias("part", "v")).select("page_id", "part", "v.top", "v.bottom")


def _framed(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "profiles").select(F.col("code").alias("profile"), F.col("width").alias("W"), F.col("height").alias("H"))
    return _pages(spark, d).where("width > 0 and height > 0").join(frames, "profile")


def ref_spread_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = G.spread_parts(F.col("width"), F.col("height"), F.col("W"), F.col("H"), "split")
    return _framed(spark, d).select("page_id", F.posexplode(parts).alias("part", "v")).select("page_id", "part", "v.order_class", "v.width", "v.height")


def ref_spread_both(spark: SparkSession, d: str) -> DataFrame:
    parts = G.spread_parts(F.col("width"), F.col("height"), F.col("W"), F.col("H"), "both")
    return _framed(spark, d).select("page_id", F.posexplode(parts).alias("part", "v")).groupBy("v.order_class").agg(F.count(F.lit(1)).alias("n"), F.sum("v.width").alias("width"), F.sum("v.height").alias("height"))


def ref_halved_parts(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).where("width > 0 and height > 0")
    return p.select("page_id", F.explode(G.halved_parts(F.col("width"), F.col("height"), 600_000)).alias("v")).select("page_id", "v.top", "v.height")


def ref_tall_parts(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).where("height > 0")
    return p.select("page_id", F.explode(G.tall_parts(F.col("height"))).alias("v")).select("page_id", "v.half", "v.top", "v.height")


def ref_contain_size(spark: SparkSession, d: str) -> DataFrame:
    size = G.contain_size(F.col("width"), F.col("height"), F.col("W"), F.col("H"))
    return _framed(spark, d).select("page_id", size.alias("s")).select("page_id", F.col("s.width").alias("new_width"), F.col("s.height").alias("new_height"))


def ref_fit_box(spark: SparkSession, d: str) -> DataFrame:
    box = G.fit_box(F.col("width"), F.col("height"), F.col("W"), F.col("H"))
    return _framed(spark, d).select("page_id", box.alias("b")).select("page_id", F.col("b.left").alias("x"), F.col("b.top").alias("y"), F.col("b.width").alias("crop_width"), F.col("b.height").alias("crop_height"))


def ref_limit_pixels(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).where("width > 0 and height > 0")
    return p.select("page_id", G.limit_pixels(F.col("width"), F.col("height"), 1_500_000).alias("s"), G.limit_width(F.col("width"), F.col("height"), 1000).alias("t")).select(
        "page_id", F.col("s.width").alias("pixel_width"), F.col("s.height").alias("pixel_height"), F.col("t.height").alias("width_height")
    )


def ref_cover_box(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).where("width > 0 and height > 0")
    return p.select("page_id", G.cover_box(F.col("width"), F.col("height")).alias("b")).where("b is not null").select("page_id", F.col("b.left").alias("x1"), F.col("b.right").alias("x2"))


def ref_resize_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = G.resize_plan(F.col("width"), F.col("height"), F.col("W"), F.col("H"))
    return _framed(spark, d).select("profile", plan.alias("p")).groupBy("profile", "p.op").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p.width") * F.col("p.height")).alias("pixels"))


def ref_clamp_box(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).where("width > 0 and height > 0")
    w, h = F.col("width"), F.col("height")
    box = G.clamp_box(F.floor(w / 8), F.floor(h / 50), w - F.floor(w / 50), h - F.floor(h / 8), w, h)
    return p.select("page_id", box.alias("b")).select("page_id", "b.left", "b.top", "b.right", "b.bottom")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    ranked = e.withColumn("y", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    cells = ranked.select("label", "y", F.posexplode("embedding").alias("x", "f"))
    return cells.select("label", "y", "x", F.floor((F.col("f").cast("double") + 1) * 128).cast("int").alias("v"))


def ref_hist(spark: SparkSession, d: str) -> DataFrame:
    return grids.histogram(_grid(spark, d), ["label"], F.col("v"))


def ref_hist_trim(spark: SparkSession, d: str) -> DataFrame:
    return grids.trim_histogram(ref_hist(spark, d), ["label"], 0.01)


def ref_minmax(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).groupBy("label").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(F.col("v") < 120).alias("n_dark"))


def ref_bbox(spark: SparkSession, d: str) -> DataFrame:
    return grids.bounding_box(_grid(spark, d), ["label"], F.col("v") < 90)


def ref_empty_lines(spark: SparkSession, d: str) -> DataFrame:
    return grids.empty_lines(_grid(spark, d), ["label"], "y", F.col("v") > 155)


def ref_border_vote(spark: SparkSession, d: str) -> DataFrame:
    return grids.border_votes(_grid(spark, d), ["label"], F.col("v") < 90)


def ref_black_point(spark: SparkSession, d: str) -> DataFrame:
    return grids.black_point(ref_hist(spark, d), ["label"], dark=120)


def ref_box_blur(spark: SparkSession, d: str) -> DataFrame:
    across = grids.box_blur(_grid(spark, d), ["label", "y"], "x", "v").withColumnRenamed("blurred", "first")
    return grids.box_blur(across, ["label", "x"], "y", "first").select("label", "x", "y", "blurred")


def ref_most_common(spark: SparkSession, d: str) -> DataFrame:
    return grouping.most_common(_pages(spark, d), ["book_id"], "width", ["chapter_ord", "page_ord", "page_id"])


def ref_people_union(spark: SparkSession, d: str) -> DataFrame:
    c = _comics(spark, d)
    return c.select("info_id", F.array_join(T.people(F.col("writers"), F.col("pencillers"), F.col("inkers"), F.col("colorists")), "|").alias("people"))


def ref_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return grouping.first_of(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "ts"])


def ref_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    """Title of each page's chapter, else of its book, else its id."""
    latest = F.max_by(F.struct("title", "chapter_titles"), "resolved_at").alias("m")
    meta = table(spark, d, "book_meta").groupBy("book_id").agg(latest).select("book_id", "m.*")
    pages = _pages(spark, d).select("page_id", "book_id", T.pad_numbers(T.slug(F.col("chapter"))).alias("slug"))
    found = pages.join(meta, "book_id", "left")
    return found.select("page_id", grouping.with_defaults(F.col("chapter_titles")[F.col("slug")], F.col("title"), F.col("book_id")).alias("title"))


def ref_positional_join(spark: SparkSession, d: str) -> DataFrame:
    """The k-th source page beside the k-th encoded page of each book."""
    left = _pages(spark, d).select("book_id", *PAGE_ORDER)
    right = _encoded(spark, d).select("book_id", F.col("chapter_ord").alias("c2"), F.col("page_ord").alias("p2"), "sub_ord", "enc_id")
    return grouping.positional_join(left, right, ["book_id"], PAGE_ORDER, ["c2", "p2", "sub_ord", "enc_id"]).select("page_id", "enc_id")


def ref_largest(spark: SparkSession, d: str) -> DataFrame:
    return grouping.largest_of(_pages(spark, d), ["book_id", "chapter"], "n_bytes", ["page_ord", "page_id"], ["page_id", "n_bytes"])


def ref_keep_lines(spark: SparkSession, d: str) -> DataFrame:
    pages = grouping.number_rows(_pages(spark, d), ["book_id"], PAGE_ORDER, "line").select("book_id", "line", "page_id", "width")
    small = pages.where("width < 900").select("book_id", "line")
    return grouping.keep_lines(pages, small, ["book_id"], "line").select("page_id", "kept_line")


def ref_fusion(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    second = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return grouping.fuse([first, second], "name").withColumn("plain", T.strip_fusion_prefix(F.col("name")))


def ref_suboptimal(spark: SparkSession, d: str) -> DataFrame:
    small = (F.col("width") < F.col("W")) & (F.col("height") < F.col("H"))
    return grouping.source_quality(_framed(spark, d), ["book_id"], small, T.stem(F.col("path")).contains("-cb"))


def ref_within_threshold(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).where("width > 0 and height > 0")
    return grouping.all_within(p, ["book_id"], L.clamp_measure("resize", F.col("width"), F.col("height")), 3_000_000)


def ref_html_escape(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", F.md5(T.html_escape(T.normalize_line_ends(F.col("text"))).cast("binary")).alias("escaped"))


def ref_titles(spark: SparkSession, d: str) -> DataFrame:
    c = _comics(spark, d)
    title = T.book_title(F.col("book_id"), F.col("series"), F.col("volume"), F.col("number"), F.col("title"), combine=True)
    return c.select("info_id", title.alias("full_title"), T.group_position(F.col("volume"), F.col("number")).alias("position"))


def ref_zfill(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.zfill(F.col("c_acctbal").cast("int").cast("string"), 6).alias("filled"))


def ref_profile_fit(spark: SparkSession, d: str) -> DataFrame:
    p = _framed(spark, d)
    return p.groupBy("profile").agg(F.count_if((F.col("width") <= F.col("W")) & (F.col("height") <= F.col("H"))).alias("n_fit"), F.count_if(F.col("width") > F.col("height")).alias("n_across"), F.count(F.lit(1)).alias("n"))


def ref_image_header(spark: SparkSession, d: str) -> DataFrame:
    """Width and height from the headers of entries, without decoding; null where the header doesn't tell."""
    e = _entries(spark, d).where("content is not null")
    return e.select("entry_id", image_size(F.col("content")).alias("s")).select("entry_id", F.col("s.width").cast("long").alias("width"), F.col("s.height").cast("long").alias("height"))


def ref_sniff(spark: SparkSession, d: str) -> DataFrame:
    """Kind of each container or entry by its first bytes, else by its name."""
    e = _entries(spark, d).select("entry_id", sniff_kind(F.col("content"), F.col("name")).alias("entry_kind"), sniff_kind(F.lit(None).cast("binary"), F.col("src")).alias("source_kind"))
    heads = F.array(*[F.struct(F.lit(k).alias("head"), F.unhex(F.lit(h)).alias("bytes")) for k, h in HEADS.items()])
    one = table(spark, d, "region").limit(1).select(F.explode(heads).alias("h")).select(F.col("h.head").alias("head"), sniff_kind(F.col("h.bytes"), F.lit("x.bin")).alias("kind"))
    return e.groupBy("entry_kind", "source_kind").agg(F.count(F.lit(1)).alias("n")).unionByName(one.select(F.col("kind").alias("entry_kind"), F.col("head").alias("source_kind"), F.lit(-1).cast("long").alias("n")))


# First bytes of containers.
HEADS = {"zip": "504B030414000000", "empty zip": "504B0506", "rar": "526172211A0700", "rar 5": "526172211A070100", "7z": "377ABCAF271C0004", "pdf": "255044462D312E34", "none": "0102", "tar": "00" * 257 + "7573746172"}


def ref_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks of each book moved past the spreads split before them."""
    pages = _encoded(spark, d).groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*ENC_ORDER, "order_class"))), lambda s: s["order_class"]).alias("classes"))
    meta = table(spark, d, "book_meta").groupBy("book_id").agg(F.max_by("bookmarks", "resolved_at").alias("bookmarks"))
    moved = meta.join(pages, "book_id").withColumn("moved", folds.bookmark_targets(F.col("bookmarks"), F.col("classes"), 1))
    return moved.select("book_id", F.posexplode("moved").alias("mark", "m")).select("book_id", "mark", "m.image", "m.title")


def ref_unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Chapter folders of each book as distinct slugs."""
    c = _pages(spark, d).where("chapter <> ''").select("book_id", "chapter").distinct()
    c = c.withColumn("slug", T.pad_numbers(T.slug(F.col("chapter")))).withColumn("key", T.natural_key(F.col("chapter")))
    return grouping.collision_names(c, ["book_id"], ["key", "chapter"], "slug", "chapter").select("book_id", "chapter", "unique_slug")


def ref_merge_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Panels of each page united where they overlap."""
    p = table(spark, d, "pages").where("panels is not null").groupBy("page_id").agg(F.max_by("panels", "page_id").alias("panels"))
    boxes = p.select("page_id", F.posexplode("panels").alias("k", "b")).where("b.top < b.bottom")
    boxes = boxes.select("page_id", "k", (F.col("k") % 3 * 100).cast("long").alias("x1"), (F.col("k") % 3 * 100 + F.when(F.col("page_id") % 2 == 0, 90).otherwise(290)).cast("long").alias("x2"), F.col("b.top").cast("long").alias("y1"), F.col("b.bottom").cast("long").alias("y2"))
    return grouping.merge_boxes(boxes, ["page_id"], ["k"]).select("page_id", "x1", "x2", "y1", "y2")


QUERIES = {name: query for name, query in dict(globals()).items() if name.startswith("ref_")}

_FRAMED = f"{_PAGES}, framed AS (SELECT p.*, f.width AS W, f.height AS H FROM pages_once p JOIN profiles f ON p.profile = f.code WHERE p.width > 0 AND p.height > 0)"
_NORMAL = f"{_ENTRIES}, normal AS (SELECT entry_id, src, coalesce(is_dir, false) OR name LIKE '%/' OR name LIKE '%\\' AS folder, {_NORM} AS path FROM entries_once)"
_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = f"lower(regexp_extract({_BASE}, '.\\.([^.]*)$', 1))"
_JUNK = f"(list_contains(string_split(path, '/'), '__MACOSX') OR starts_with({_BASE}, '._') OR lower({_BASE}) IN ('.ds_store', 'thumbs.db'))"
_BARE = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_PAD = r"regexp_replace(CASE WHEN regexp_matches({0}, '[0-9][^0-9]+[0-9]') THEN regexp_replace({0}, '^([^0-9]*)([0-9]+)([^0-9]+)([0-9]+)', '\10000\2\30000\4') ELSE regexp_replace({0}, '^([^0-9]*)([0-9]+)', '\10000\2') END, '0*([0-9]{{4,}})', '\1', 'g')"
_GRID = "grid AS (SELECT label, y, unnest(range(len(embedding))) AS x, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 128) AS INT) AS v FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y FROM embeddings))"
_HIST = f"{_GRID}, hist AS (SELECT label, v AS bin, count(*) AS n FROM grid GROUP BY label, v)"


def _overlap_cte(view: int) -> str:
    """Parts of pages that overlap in views of some rows, as ``p(page_id, part, top, bottom)``."""
    return f"""h AS (SELECT page_id, CAST(height AS BIGINT) AS h FROM pages_once WHERE height > 0), n AS (SELECT *, CAST(ceil(h / {view}.0) AS BIGINT) AS parts FROM h), p AS (
SELECT page_id, 0 AS part, 0 AS top, CASE WHEN h <= {view * 3 // 2} THEN h WHEN h <= {view * 2} THEN {view} ELSE {view} END AS bottom FROM n
UNION ALL SELECT page_id, part, part * (h // parts), part * (h // parts) + {view} FROM (SELECT page_id, h, parts, unnest(range(1, parts - 1)) AS part FROM n WHERE h > {view * 2})
UNION ALL SELECT page_id, CASE WHEN h <= {view * 2} THEN 1 ELSE parts - 1 END, h - {view}, h FROM n WHERE h > {view * 3 // 2})"""


def _pack_cte(items: str, cap: int) -> str:
    """Recursive greedy packing of ``items(g, k, size)`` with k = 1.. in each group g."""
    return f"""packed(g, k, shard, load) AS (SELECT g, k, CAST(0 AS BIGINT), CAST(size AS BIGINT) FROM {items} WHERE k = 1
UNION ALL SELECT i.g, i.k, CASE WHEN p.load + i.size > {cap} THEN p.shard + 1 ELSE p.shard END, CASE WHEN p.load + i.size > {cap} THEN CAST(i.size AS BIGINT) ELSE CAST(p.load + i.size AS BIGINT) END FROM packed p JOIN {items} i ON i.g = p.g AND i.k = p.k + 1)"""


_ENC_ITEMS = f"{_ENC}, items AS (SELECT book_id AS g, row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord, page_ord, sub_ord, enc_id) AS k, coalesce(n_bytes, 0) AS size, enc_id FROM enc)"
_PACK = f"WITH RECURSIVE {_ENC_ITEMS}, {_pack_cte('items', CAPACITY)}, shards AS (SELECT g AS book_id, shard, count(*) AS n_pages, sum(size) AS bytes FROM packed JOIN items USING (g, k) GROUP BY g, shard)"
_BANDS = "bands AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS band FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL), marked AS (SELECT *, sum(CAST(value < 50 AS INT)) OVER (PARTITION BY user_id ORDER BY band ROWS UNBOUNDED PRECEDING) AS run FROM bands), found AS (SELECT user_id, min(band) AS top, max(band) + 1 AS bottom FROM marked WHERE NOT value < 50 GROUP BY user_id, run), panels_kept AS (SELECT * FROM found WHERE NOT (top < 2 AND bottom - top < 2))"


def _sides_sql(rtl: bool) -> str:
    first, second = ("right", "left") if rtl else ("left", "right")
    flip = {"left": "right", "right": "left"}
    opening = "right" if rtl else "left"

    def alternate(start: str, steps: str) -> str:
        return f"CASE WHEN ({steps}) % 2 = 0 THEN '{start}' ELSE '{flip[start]}' END"

    return f"""WITH {_ENC}, p AS (SELECT enc_id, book_id, order_class, row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord, page_ord, sub_ord, enc_id) - 1 AS i FROM enc),
q AS (SELECT *, min(CASE WHEN order_class <> 'x' THEN i END) OVER (PARTITION BY book_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx, max(CASE WHEN order_class <> 'x' THEN i END) OVER (PARTITION BY book_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM p)
SELECT enc_id, CASE WHEN order_class IN ('a', 'd') THEN 'center' WHEN order_class = 'b' THEN '{first}' WHEN order_class = 'c' THEN '{second}' WHEN nx IS NOT NULL THEN {alternate(second, 'nx - i - 1')} WHEN pv IS NOT NULL THEN {alternate(first, 'i - pv - 1')} ELSE {alternate(opening, 'i')} END AS side FROM q"""


_RATIO = "CAST(width AS DOUBLE) / height"
_FRAME = "CAST(W AS DOUBLE) / H"
_ACROSS = "((width > height) <> (W > H))"

ORACLE = {
    "ref_normalize_path": f"WITH {_NORMAL} SELECT entry_id, path, folder FROM normal",
    "ref_path_parts": f"WITH {_NORMAL} SELECT entry_id, regexp_replace(path, '(^|/)[^/]*$', '') AS parent, {_BASE} AS base, CASE WHEN regexp_matches({_BASE}, '.\\.[^.]*$') THEN regexp_replace({_BASE}, '\\.[^.]*$', '') ELSE {_BASE} END AS stem, {_EXT} AS ext, len(string_split(path, '/')) AS depth FROM normal WHERE path IS NOT NULL",
    "ref_image_filter": f"WITH {_NORMAL}, f AS (SELECT src, {_JUNK} AS junk, {_EXT} AS ext, {_BASE} AS base FROM normal WHERE path IS NOT NULL AND NOT folder) SELECT src, count(*) FILTER (junk) AS n_junk, count(*) FILTER (NOT junk AND ext IN ('jpg','jpeg','png','gif','bmp','webp','tiff','tif','avif')) AS n_images, count(*) FILTER (NOT junk AND ext IN ('png','jpg','jpeg','gif','webp')) AS n_pages, count(*) FILTER (NOT junk AND base = 'ComicInfo.xml') AS n_meta FROM f GROUP BY src",
    "ref_single_root": f"WITH {_NORMAL} SELECT src, CASE WHEN count(DISTINCT string_split(path, '/')[1]) FILTER (NOT {_JUNK}) = 1 AND NOT coalesce(bool_or(NOT folder AND path NOT LIKE '%/%') FILTER (NOT {_JUNK}), false) THEN min(string_split(path, '/')[1]) FILTER (NOT {_JUNK}) END AS root FROM normal WHERE path IS NOT NULL GROUP BY src",
    "ref_chapter_pages": f"WITH {_PAGES} SELECT book_id, chapter, count(*) AS n_pages, sum(n_bytes) AS bytes, arg_min(page_id, {{'a': page_ord, 'b': page_id}}) AS first_page, max(page_ord) AS last_ord FROM pages_once GROUP BY book_id, chapter",
    "ref_page_number": f"WITH {_PAGES}, n AS (SELECT page_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord NULLS FIRST, page_ord NULLS FIRST, page_id) AS ordinal FROM pages_once) SELECT page_id, ordinal, printf('cb-%04d', ordinal) AS name FROM n",
    "ref_slug_pad": f"WITH {_COMICS}, s AS (SELECT info_id, {_SLUG.format('series')} AS slug FROM comics WHERE series IS NOT NULL) SELECT info_id, slug, {_PAD.format('slug')} AS padded FROM s",
    "ref_natural_rank": f"WITH {_ENTRIES} SELECT entry_id, row_number() OVER (PARTITION BY src ORDER BY {_NATKEY}, name, entry_id) AS rank FROM entries_once WHERE name IS NOT NULL",
    "ref_natural_sorted": f"WITH {_ENTRIES}, u AS (SELECT DISTINCT src, name FROM entries_once WHERE name IS NOT NULL), r AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY {_NATKEY}, name) AS a, row_number() OVER (PARTITION BY src ORDER BY name) AS b FROM u) SELECT src, bool_and(a = b) AS natural FROM r GROUP BY src",
    "ref_folder_prefixes": f"WITH {_PAGES}, s AS (SELECT book_id, string_split(path, '/') AS parts FROM pages_once WHERE path LIKE '%/%'), e AS (SELECT book_id, array_to_string(parts[1:n], '/') AS folder FROM (SELECT book_id, parts, unnest(range(1, len(parts))) AS n FROM s)) SELECT book_id, folder, count(*) AS n_below FROM e GROUP BY book_id, folder",
    "ref_uniform_depth": f"WITH {_PAGES} SELECT book_id, min(len(string_split(path, '/'))) AS level, min(len(string_split(path, '/'))) <> max(len(string_split(path, '/'))) AS mixed FROM pages_once WHERE path IS NOT NULL GROUP BY book_id",
    "ref_greedy_pack": f"{_PACK} SELECT book_id, shard, n_pages, bytes FROM shards",
    "ref_shard_titles": f"{_PACK}, t AS (SELECT *, max(shard) OVER (PARTITION BY book_id) + 1 AS total FROM shards) SELECT book_id, shard, CASE WHEN total > 9 THEN printf('%s [%02d/%02d]', book_id, shard + 1, total) ELSE printf('%s [%d/%d]', book_id, shard + 1, total) END AS title FROM t",
    "ref_pack_pairs": f"WITH RECURSIVE {_ENC}, o AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord, page_ord, sub_ord, enc_id) AS r FROM enc), j AS (SELECT *, CASE WHEN half = 'below' AND lag(half) OVER (PARTITION BY book_id ORDER BY r) = 'above' THEN 0 ELSE 1 END AS opens FROM o), u AS (SELECT *, sum(opens) OVER (PARTITION BY book_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS unit FROM j), items AS (SELECT book_id AS g, unit AS k, sum(coalesce(n_bytes, 0)) AS size, count(*) AS n FROM u GROUP BY book_id, unit), {_pack_cte('items', CAPACITY)} SELECT g AS book_id, shard, CAST(sum(n) AS BIGINT) AS n_pages, CAST(sum(size) AS BIGINT) AS bytes FROM packed JOIN items USING (g, k) GROUP BY g, shard",
    "ref_pack_chapters": f"WITH RECURSIVE {_ENC}, c AS (SELECT book_id, chapter, CAST(sum(coalesce(n_bytes, 0)) AS BIGINT) AS bytes, min(chapter_ord) AS ord FROM enc GROUP BY book_id, chapter), items AS (SELECT book_id AS g, row_number() OVER (PARTITION BY book_id ORDER BY ord, chapter) AS k, bytes AS size, chapter FROM c), {_pack_cte('items', 4 * CAPACITY)} SELECT g AS book_id, chapter, size AS bytes, shard FROM packed JOIN items USING (g, k)",
    "ref_chapter_runs": f"WITH {_PAGES}, m AS (SELECT book_id, chapter, page_id, CASE WHEN row_number() OVER (PARTITION BY book_id ORDER BY page_id) = 1 OR chapter IS DISTINCT FROM lag(chapter) OVER (PARTITION BY book_id ORDER BY page_id) THEN 1 ELSE 0 END AS c FROM pages_once), r AS (SELECT *, sum(c) OVER (PARTITION BY book_id ORDER BY page_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM m) SELECT book_id, run, max(chapter) AS chapter, count(*) AS n_pages FROM r GROUP BY book_id, run",
    "ref_event_runs": "WITH m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM m) SELECT user_id, run, max(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run",
    "ref_spread_sides": _sides_sql(False),
    "ref_spread_sides_rtl": _sides_sql(True),
    "ref_gap_groups": """WITH RECURSIVE m AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS v FROM events), o AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v) AS k FROM m),
s(user_id, k, first, last, out_first, out_last) AS (SELECT user_id, k, v, v, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k, CASE WHEN s.first IS NULL THEN o.v WHEN o.v - s.last <= 60 THEN s.first END, CASE WHEN s.first IS NULL OR o.v - s.last <= 60 THEN o.v END, CASE WHEN s.first IS NOT NULL AND o.v - s.last > 60 THEN s.first END, CASE WHEN s.first IS NOT NULL AND o.v - s.last > 60 THEN s.last END FROM s JOIN o ON o.user_id IS NOT DISTINCT FROM s.user_id AND o.k = s.k + 1)
SELECT user_id, out_first AS first_value, out_last AS last_value FROM s WHERE out_first IS NOT NULL UNION ALL SELECT user_id, first, last FROM s WHERE first IS NOT NULL AND k = (SELECT max(k) FROM o WHERE o.user_id IS NOT DISTINCT FROM s.user_id)""",
    "ref_panel_scan": f"WITH {_BANDS} SELECT user_id, top, bottom FROM panels_kept",
    "ref_pack_heights": f"WITH RECURSIVE {_BANDS}, o AS (SELECT user_id, top, bottom, bottom - top AS h, row_number() OVER (PARTITION BY user_id ORDER BY top) AS k FROM panels_kept), s(user_id, k, page, room) AS (SELECT user_id, k, CAST(0 AS BIGINT), CAST(8 - h AS BIGINT) FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN s.room - o.h > 0 THEN s.page ELSE s.page + 1 END, CASE WHEN s.room - o.h > 0 THEN s.room - o.h ELSE 8 - o.h END FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1) SELECT user_id, top, bottom, page AS virtual_page FROM s JOIN o USING (user_id, k)",
    "ref_overlap_parts": f"WITH {_PAGES}, {_overlap_cte(1400)} SELECT page_id, CAST(part AS INT) AS part, CAST(top AS BIGINT) AS top, CAST(bottom AS BIGINT) AS bottom FROM p",
    "ref_spread_parts": f"WITH {_FRAMED}, k AS (SELECT *, {_RATIO} AS ratio, {_ACROSS} AS across FROM framed) SELECT page_id, 0 AS part, 'x' AS order_class, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height FROM k WHERE NOT (across AND ratio > 1.16) UNION ALL SELECT page_id, i, CASE i WHEN 0 THEN 'b' ELSE 'c' END, width // 2, height FROM k, (VALUES (0), (1)) v(i) WHERE across AND ratio > 1.16 AND ratio < 1.8 UNION ALL SELECT page_id, 0, 'd', height, width FROM k WHERE across AND ratio >= 1.8",
    "ref_spread_both": f"WITH {_FRAMED}, k AS (SELECT *, {_RATIO} AS ratio, {_ACROSS} AS across FROM framed), u AS (SELECT 'x' AS order_class, CAST(width AS BIGINT) AS w, CAST(height AS BIGINT) AS h FROM k WHERE NOT (across AND ratio > 1.16) UNION ALL SELECT CASE i WHEN 0 THEN 'b' ELSE 'c' END, width // 2, height FROM k, (VALUES (0), (1)) v(i) WHERE across AND ratio > 1.16 AND ratio < 1.8 UNION ALL SELECT 'd', height, width FROM k WHERE across AND ratio > 1.16) SELECT order_class, count(*) AS n, CAST(sum(w) AS BIGINT) AS width, CAST(sum(h) AS BIGINT) AS height FROM u GROUP BY order_class",
    "ref_halved_parts": f"WITH RECURSIVE {_PAGES}, s(page_id, w, top, h) AS (SELECT page_id, CAST(width AS BIGINT), CAST(0 AS BIGINT), CAST(height AS BIGINT) FROM pages_once WHERE width > 0 AND height > 0 UNION ALL SELECT page_id, w, CASE i WHEN 0 THEN top ELSE top + h // 2 END, CASE i WHEN 0 THEN h // 2 ELSE h - h // 2 END FROM s, (VALUES (0), (1)) v(i) WHERE w * h >= 600000 AND h > 1) SELECT page_id, top, h AS height FROM s WHERE NOT (w * h >= 600000 AND h > 1)",
    "ref_tall_parts": f"WITH {_PAGES} SELECT page_id, half, CAST(top AS BIGINT) AS top, CAST(height AS BIGINT) AS height FROM (SELECT page_id, 'none' AS half, 0 AS top, height FROM pages_once WHERE height > 0 AND height <= 1920 UNION ALL SELECT page_id, 'above', 0, 1920 FROM pages_once WHERE height > 1920 UNION ALL SELECT page_id, 'below', 1920, height - 1920 FROM pages_once WHERE height > 1920)",
    "ref_contain_size": f"WITH {_FRAMED} SELECT page_id, CAST(CASE WHEN {_RATIO} >= {_FRAME} THEN W ELSE greatest(round({_RATIO} * H), 1) END AS BIGINT) AS new_width, CAST(CASE WHEN {_RATIO} <= {_FRAME} THEN H ELSE greatest(round(CAST(height AS DOUBLE) / width * W), 1) END AS BIGINT) AS new_height FROM framed",
    "ref_fit_box": f"WITH {_FRAMED} SELECT page_id, CAST(CASE WHEN {_FRAME} < {_RATIO} AND abs({_FRAME} - {_RATIO}) >= 2.220446049250313e-16 THEN floor(greatest(width - round(height * ({_FRAME})), 0) / 2) ELSE 0 END AS BIGINT) AS x, CAST(CASE WHEN {_FRAME} > {_RATIO} AND abs({_FRAME} - {_RATIO}) >= 2.220446049250313e-16 THEN floor(greatest(height - round(width / ({_FRAME})), 0) / 2) ELSE 0 END AS BIGINT) AS y, CAST(CASE WHEN {_FRAME} < {_RATIO} AND abs({_FRAME} - {_RATIO}) >= 2.220446049250313e-16 THEN greatest(round(height * ({_FRAME})), 1) ELSE width END AS BIGINT) AS crop_width, CAST(CASE WHEN {_FRAME} > {_RATIO} AND abs({_FRAME} - {_RATIO}) >= 2.220446049250313e-16 THEN greatest(round(width / ({_FRAME})), 1) ELSE height END AS BIGINT) AS crop_height FROM framed",
    "ref_limit_pixels": f"WITH {_PAGES}, s AS (SELECT page_id, width, height, sqrt(1500000.0::DOUBLE / CAST(CAST(width AS BIGINT) * height AS DOUBLE)) AS f, CAST(width AS BIGINT) * height <= 1500000 AS small FROM pages_once WHERE width > 0 AND height > 0) SELECT page_id, CAST(CASE WHEN small THEN width ELSE greatest(round(width * f), 1) END AS BIGINT) AS pixel_width, CAST(CASE WHEN small THEN height ELSE greatest(round(height * f), 1) END AS BIGINT) AS pixel_height, CAST(CASE WHEN width <= 1000 THEN height ELSE greatest(round(height * (1000.0::DOUBLE / CAST(width AS DOUBLE))), 1) END AS BIGINT) AS width_height FROM s",
    "ref_cover_box": f"WITH {_PAGES}, r AS (SELECT page_id, CAST(width AS DOUBLE) AS w, {_RATIO} AS ratio FROM pages_once WHERE width > 0 AND height > 0), b AS (SELECT page_id, w, CASE WHEN ratio > 2.0 THEN 1.0::DOUBLE / 6 WHEN ratio > 1.83 THEN 0.19 WHEN ratio > 1.7 THEN 0.2 WHEN ratio > 1.34 THEN 0 ELSE 0.36 END AS a, CASE WHEN ratio > 2.0 THEN 0.48 WHEN ratio > 1.83 THEN 0.575 WHEN ratio > 1.7 THEN 0.583 WHEN ratio > 1.34 THEN 0.47 ELSE 1 END AS b FROM r WHERE ratio > 1.0) SELECT page_id, CAST(round_even(w * CAST(a AS DOUBLE), 0) AS BIGINT) AS x1, CAST(round_even(w * CAST(b AS DOUBLE), 0) AS BIGINT) AS x2 FROM b",
    "ref_resize_plan": f"WITH {_FRAMED}, k AS (SELECT *, {_RATIO} AS r, {_FRAME} AS f FROM framed), p AS (SELECT profile, CASE WHEN width <= W AND height <= H THEN 'keep' WHEN abs(CAST(height AS DOUBLE) / width - CAST(H AS DOUBLE) / W) < 0.015 THEN 'fit' ELSE 'contain' END AS op, * EXCLUDE (profile) FROM k) SELECT profile, op, count(*) AS n, CAST(sum(CASE op WHEN 'keep' THEN CAST(width AS BIGINT) * height WHEN 'fit' THEN CAST(W AS BIGINT) * H ELSE CAST(CASE WHEN r >= f THEN W ELSE greatest(round(r * H), 1) END AS BIGINT) * CAST(CASE WHEN r <= f THEN H ELSE greatest(round(CAST(height AS DOUBLE) / width * W), 1) END AS BIGINT) END) AS BIGINT) AS pixels FROM p GROUP BY profile, op",
    "ref_clamp_box": f'WITH {_PAGES} SELECT page_id, CAST(round_even(least(CAST(width // 8 AS DOUBLE), width * 0.1::DOUBLE), 0) AS BIGINT) AS "left", CAST(round_even(least(CAST(height // 50 AS DOUBLE), height * 0.1::DOUBLE), 0) AS BIGINT) AS top, CAST(round_even(greatest(CAST(width - width // 50 AS DOUBLE), width * 0.9::DOUBLE), 0) AS BIGINT) AS "right", CAST(round_even(greatest(CAST(height - height // 8 AS DOUBLE), height * 0.9::DOUBLE), 0) AS BIGINT) AS bottom FROM pages_once WHERE width > 0 AND height > 0',
    "ref_hist": f"WITH {_HIST} SELECT label, bin, n FROM hist",
    "ref_hist_trim": f"WITH {_HIST}, a AS (SELECT label, bin, n, CAST(floor(sum(n) OVER (PARTITION BY label) * 0.01::DOUBLE) AS BIGINT) AS cut, sum(n) OVER (PARTITION BY label ORDER BY bin ROWS UNBOUNDED PRECEDING) - n AS below FROM hist), b AS (SELECT label, bin, cut, greatest(0, n - greatest(0, cut - below)) AS n FROM a), c AS (SELECT label, bin, cut, n, sum(n) OVER (PARTITION BY label ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) - n AS above FROM b), e AS (SELECT label, bin, greatest(0, n - greatest(0, cut - above)) AS n FROM c) SELECT label, bin, CAST(n AS BIGINT) AS n FROM e WHERE n > 0",
    "ref_minmax": f"WITH {_GRID} SELECT label, min(v) AS least, max(v) AS most, count(*) FILTER (v < 120) AS n_dark FROM grid GROUP BY label",
    "ref_bbox": f"WITH {_GRID} SELECT label, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS n FROM grid WHERE v < 90 GROUP BY label",
    "ref_empty_lines": f"WITH {_GRID} SELECT label, y AS line FROM grid GROUP BY label, y HAVING NOT bool_or(v > 155)",
    "ref_border_vote": f"""WITH {_GRID}, g AS (SELECT label, x, y, CAST(v < 90 AS INT) AS black, max(x) OVER (PARTITION BY label) + 1 AS w, max(y) OVER (PARTITION BY label) + 1 AS h FROM grid),
s AS (SELECT label, 'y' AS axis, unnest(range(CAST((h + 4) // 5 AS BIGINT))) AS strip, w, h FROM (SELECT DISTINCT label, w, h FROM g) UNION ALL SELECT label, 'x', unnest(range(CAST((w + 4) // 5 AS BIGINT))), w, h FROM (SELECT DISTINCT label, w, h FROM g)),
t AS (SELECT label, axis, strip, CASE WHEN strip * 5 + 5 > CASE axis WHEN 'y' THEN h ELSE w END THEN greatest(CASE axis WHEN 'y' THEN h ELSE w END - 5, 0) ELSE strip * 5 END AS a FROM s),
c AS (SELECT t.label, t.axis, t.strip, count(*) AS area, sum(black) AS blacks FROM t JOIN g ON g.label = t.label AND CASE t.axis WHEN 'y' THEN g.y ELSE g.x END >= a AND CASE t.axis WHEN 'y' THEN g.y ELSE g.x END < a + 5 GROUP BY t.label, t.axis, t.strip)
SELECT label, CAST(sum(CASE WHEN blacks = 0 THEN -area WHEN blacks = area THEN area ELSE 0 END) AS BIGINT) AS total FROM c GROUP BY label""",
    "ref_black_point": f"WITH {_HIST}, m AS (SELECT label, coalesce(max(n) FILTER (bin < 120), 0) AS most FROM hist GROUP BY label) SELECT m.label, coalesce((SELECT min(bin) FROM hist h WHERE h.label = m.label AND h.n = m.most), 0) AS black_point FROM m",
    "ref_box_blur": f"WITH {_GRID}, a AS (SELECT label, x, y, (coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v) + 1) // 3 AS f FROM grid WINDOW w AS (PARTITION BY label, y ORDER BY x)) SELECT label, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST((coalesce(lag(f) OVER w, f) + f + coalesce(lead(f) OVER w, f) + 1) // 3 AS BIGINT) AS blurred FROM a WINDOW w AS (PARTITION BY label, x ORDER BY y)",
    "ref_most_common": f"WITH {_PAGES}, c AS (SELECT book_id, width, count(*) AS n, min({{'a': chapter_ord, 'b': page_ord, 'c': page_id}}) AS seen FROM pages_once WHERE width IS NOT NULL GROUP BY book_id, width) SELECT book_id, width, n FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, seen) AS r FROM c) WHERE r = 1",
    "ref_people_union": f"WITH {_COMICS}, p AS (SELECT info_id, list_sort(list_distinct(list_filter(list_concat(string_split(coalesce(writers, ''), ', '), string_split(coalesce(pencillers, ''), ', '), string_split(coalesce(inkers, ''), ', '), string_split(coalesce(colorists, ''), ', ')), lambda x: x <> ''))) AS l FROM comics) SELECT info_id, CASE WHEN len(l) = 0 THEN 'cb' ELSE array_to_string(l, '|') END AS people FROM p",
    "ref_first_wins": "SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "ref_lookup_default": f"WITH {_PAGES}, m AS (SELECT book_id, title, chapter_titles FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY resolved_at DESC) AS r FROM book_meta) WHERE r = 1), s AS (SELECT page_id, book_id, {_SLUG.format('chapter')} AS slug FROM pages_once), q AS (SELECT page_id, book_id, {_PAD.format('slug')} AS slug FROM s) SELECT page_id, coalesce(element_at(chapter_titles, slug)[1], title, q.book_id) AS title FROM q LEFT JOIN m ON q.book_id = m.book_id",
    "ref_positional_join": f"WITH {_PAGES}, {_ENC}, a AS (SELECT book_id, page_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord NULLS FIRST, page_ord NULLS FIRST, page_id) AS r FROM pages_once), b AS (SELECT book_id, enc_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord, page_ord, sub_ord, enc_id) AS r FROM enc) SELECT page_id, enc_id FROM a LEFT JOIN b USING (book_id, r)",
    "ref_largest": f"WITH {_PAGES} SELECT book_id, chapter, page_id, n_bytes FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter ORDER BY coalesce(n_bytes, -1) DESC, page_ord, page_id) AS r FROM pages_once) WHERE r = 1",
    "ref_keep_lines": f"WITH {_PAGES}, n AS (SELECT page_id, book_id, width, row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord NULLS FIRST, page_ord NULLS FIRST, page_id) AS line FROM pages_once) SELECT page_id, row_number() OVER (PARTITION BY book_id ORDER BY line) - 1 AS kept_line FROM n WHERE NOT coalesce(width < 900, false)",
    "ref_fusion": "SELECT 'fusion_0001_' || s_name AS name, s_suppkey AS id, 1 AS source_ord, s_name AS plain FROM supplier UNION ALL SELECT 'fusion_0002_' || c_name, c_custkey, 2, c_name FROM customer",
    "ref_suboptimal": f"WITH {_FRAMED} SELECT book_id, count(*) FILTER (width < W AND height < H) AS n_small, count(*) AS n, count(*) FILTER (width < W AND height < H) * 4 > count(*) AS suboptimal, bool_or(contains(CASE WHEN regexp_matches(regexp_extract(path, '([^/]*)$', 1), '.\\.[^.]*$') THEN regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') ELSE regexp_extract(path, '([^/]*)$', 1) END, '-cb')) AS processed FROM framed GROUP BY book_id",
    "ref_within_threshold": f"WITH {_PAGES} SELECT book_id, bool_and(CAST(width AS BIGINT) * height < 3000000) AS within FROM pages_once WHERE width > 0 AND height > 0 GROUP BY book_id",
    "ref_html_escape": "SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM documents WHERE text IS NOT NULL",
    "ref_titles": f"WITH {_COMICS}, z AS (SELECT *, CASE WHEN length(volume) >= 2 THEN volume ELSE lpad(volume, 2, '0') END AS v, CASE WHEN length(number) >= 3 THEN number ELSE lpad(number, 3, '0') END AS n FROM comics) SELECT info_id, CASE WHEN coalesce(series, '') <> '' THEN series ELSE book_id END || CASE WHEN coalesce(volume, '') <> '' THEN ' Vol. ' || v ELSE '' END || CASE WHEN coalesce(number, '') <> '' THEN ' #' || n ELSE '' END || CASE WHEN coalesce(title, '') <> '' THEN ': ' || title ELSE '' END AS full_title, nullif(concat_ws('.', nullif(volume, ''), nullif(number, '')), '') AS position FROM z",
    "ref_zfill": "WITH s AS (SELECT c_custkey, CAST(CAST(trunc(c_acctbal) AS INT) AS VARCHAR) AS v FROM customer) SELECT c_custkey, CASE WHEN length(v) >= 6 THEN v WHEN v[1] = '-' THEN '-' || lpad(v[2:], 5, '0') ELSE lpad(v, 6, '0') END AS filled FROM s",
    "ref_profile_fit": f"WITH {_FRAMED} SELECT profile, count(*) FILTER (width <= W AND height <= H) AS n_fit, count(*) FILTER (width > height) AS n_across, count(*) AS n FROM framed GROUP BY profile",
    "ref_sniff": f"WITH {_ENTRIES}, h AS (SELECT hex(content) AS h, name, src FROM entries_once), k AS (SELECT CASE WHEN starts_with(h, '504B0304') OR starts_with(h, '504B0506') THEN 'zip' WHEN starts_with(h, '526172211A07') THEN 'rar' WHEN starts_with(h, '377ABCAF271C') THEN '7z' WHEN substr(h, 515, 10) = '7573746172' THEN 'tar' WHEN starts_with(h, '25504446') THEN 'pdf' ELSE CASE WHEN lower(regexp_extract(name, '([^/]*)$', 1)) SIMILAR TO '.+\\.(zip|cbz|epub)' THEN 'zip' WHEN lower(regexp_extract(name, '([^/]*)$', 1)) SIMILAR TO '.+\\.(tar|cbt)' THEN 'tar' WHEN lower(regexp_extract(name, '([^/]*)$', 1)) SIMILAR TO '.+\\.(rar|cbr)' THEN 'rar' WHEN lower(regexp_extract(name, '([^/]*)$', 1)) SIMILAR TO '.+\\.(7z|cb7)' THEN '7z' END END AS entry_kind, CASE WHEN lower(regexp_extract(src, '([^/]*)$', 1)) SIMILAR TO '.+\\.(zip|cbz|epub)' THEN 'zip' WHEN lower(regexp_extract(src, '([^/]*)$', 1)) SIMILAR TO '.+\\.(tar|cbt)' THEN 'tar' WHEN lower(regexp_extract(src, '([^/]*)$', 1)) SIMILAR TO '.+\\.(rar|cbr)' THEN 'rar' WHEN lower(regexp_extract(src, '([^/]*)$', 1)) SIMILAR TO '.+\\.(7z|cb7)' THEN '7z' END AS source_kind FROM h) SELECT entry_kind, source_kind, count(*) AS n FROM k GROUP BY ALL UNION ALL VALUES ('zip', 'zip', -1), ('zip', 'empty zip', -1), ('rar', 'rar', -1), ('rar', 'rar 5', -1), ('7z', '7z', -1), ('pdf', 'pdf', -1), (NULL, 'none', -1), ('tar', 'tar', -1)",
    "ref_matching_root": f"WITH {_NORMAL}, r AS (SELECT src, CASE WHEN count(DISTINCT string_split(path, '/')[1]) FILTER (NOT {_JUNK}) = 1 AND NOT coalesce(bool_or(NOT folder AND path NOT LIKE '%/%') FILTER (NOT {_JUNK}), false) THEN min(string_split(path, '/')[1]) FILTER (NOT {_JUNK}) END AS root FROM normal WHERE path IS NOT NULL GROUP BY src), m AS (SELECT book_id, max(series) AS series FROM book_meta WHERE book_id IS NOT NULL GROUP BY book_id), b AS (SELECT src, root, {_BARE.format('root')} AS x, {_BARE.format('r.book')} AS y, {_BARE.format('series')} AS z FROM (SELECT *, regexp_extract(src, '^(.*)\\.[^.]*$', 1) AS book FROM r WHERE root IS NOT NULL) r LEFT JOIN m ON r.book = m.book_id) SELECT src, root, coalesce(x <> '' AND y <> '' AND (contains(y, x) OR contains(x, y)), false) OR coalesce(x <> '' AND z <> '' AND (contains(z, x) OR contains(x, z)), false) AS matches FROM b",
    "ref_folder_order": f"WITH {_NORMAL}, f AS (SELECT DISTINCT src, regexp_replace(path, '(^|/)[^/]*$', '') AS dir FROM normal WHERE path IS NOT NULL) SELECT src, dir, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN dir = '' THEN [] ELSE list_transform(string_split(dir, '/'), lambda name: {_NATKEY}) END, dir) AS rank FROM f",
    "ref_bookmarks": f"""WITH RECURSIVE {_ENC}, o AS (SELECT book_id, row_number() OVER w AS r, CAST(sum(CASE WHEN order_class = 'b' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS nb FROM enc WINDOW w AS (PARTITION BY book_id ORDER BY chapter_ord, page_ord, sub_ord, enc_id)), cum AS (SELECT * FROM o UNION ALL SELECT DISTINCT book_id, 0, 0 FROM o), n AS (SELECT book_id, max(r) AS pages FROM o GROUP BY book_id),
meta AS (SELECT book_id, bookmarks FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY resolved_at DESC) AS a FROM book_meta) WHERE a = 1 AND book_id IS NOT NULL), marks AS (SELECT book_id, unnest(range(1, len(bookmarks) + 1)) AS k, unnest(bookmarks) AS m FROM meta JOIN n USING (book_id)),
s(book_id, k, shift, image, kept, title) AS (SELECT DISTINCT book_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, '' FROM marks UNION ALL SELECT m.book_id, m.k, coalesce(nb, 0), m.m.image + nb, coalesce(m.m.image + s.shift < pages AND m.m.image + nb < pages AND m.m.image >= 0, false), m.m.title FROM s JOIN marks m ON m.book_id = s.book_id AND m.k = s.k + 1 JOIN n ON n.book_id = m.book_id LEFT JOIN cum ON cum.book_id = m.book_id AND cum.r = greatest(least(m.m.image + s.shift + 1, pages), 0))
SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY k) - 1 AS INT) AS mark, CAST(image AS INT) AS image, title FROM s WHERE kept""",
    "ref_unique_slugs": f"""WITH RECURSIVE {_PAGES}, c0 AS (SELECT DISTINCT book_id, chapter FROM pages_once WHERE chapter <> ''), c1 AS (SELECT *, {_SLUG.format('chapter')} AS plain FROM c0), c AS (SELECT book_id, chapter, {_PAD.format('plain')} AS slug, row_number() OVER (PARTITION BY book_id ORDER BY {_NATKEY.replace('lower(name)', 'lower(chapter)')}, chapter) AS k FROM c1),
s(book_id, k, used, chapter, unique_slug) AS (SELECT DISTINCT book_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), '', '' FROM c UNION ALL SELECT book_id, k, list_append(used, own), chapter, own FROM (SELECT c.book_id, c.k, s.used, c.chapter, c.slug || repeat('A', list_filter(range(0, len(s.used) + 1), lambda j: NOT list_contains(s.used, c.slug || repeat('A', j)) OR upper(c.chapter) = upper(c.slug || repeat('A', j)))[1]) AS own FROM s JOIN c ON c.book_id = s.book_id AND c.k = s.k + 1))
SELECT book_id, chapter, unique_slug FROM s WHERE k > 0""",
    "ref_merge_boxes": "WITH p AS (SELECT page_id, any_value(panels) AS panels FROM pages WHERE panels IS NOT NULL GROUP BY page_id), u AS (SELECT page_id, unnest(range(len(panels))) AS k, unnest(panels) AS u FROM p), b AS (SELECT page_id, k, CASE WHEN page_id % 2 = 0 THEN k % 3 ELSE 0 END AS part, k % 3 * 100 AS x1, k % 3 * 100 + CASE WHEN page_id % 2 = 0 THEN 90 ELSE 290 END AS x2, CAST(u.top AS BIGINT) AS a, CAST(u.bottom AS BIGINT) AS b FROM u WHERE u.top < u.bottom), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY page_id, part ORDER BY a, b, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM b), r AS (SELECT *, sum(opens) OVER (PARTITION BY page_id, part ORDER BY a, b, k ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT page_id, CAST(min(x1) AS BIGINT) AS x1, CAST(max(x2) AS BIGINT) AS x2, min(a) AS y1, max(b) AS y2 FROM r GROUP BY page_id, part, run",
    "ref_image_header": f"WITH {_ENTRIES}, h AS (SELECT entry_id, hex(content) AS h FROM entries_once WHERE content IS NOT NULL) SELECT entry_id, CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN TRY_CAST('0x' || nullif(substr(h, 33, 8), '') AS BIGINT) END AS width, CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN TRY_CAST('0x' || nullif(substr(h, 41, 8), '') AS BIGINT) END AS height FROM h",
}
