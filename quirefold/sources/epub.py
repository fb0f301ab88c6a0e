"""Pages of EPUB files: the largest image that each document of the reading order refers to."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import extension, parent, resolve_relative

_OPF = "struct<items:array<struct<id:string,href:string>>,spine:array<string>>"


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, dict[str, str]]] = []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag.rpartition(":")[2], {k.rpartition(":")[2]: v or "" for k, v in attrs}))


def tags(data: bytes | None) -> list[tuple[str, dict[str, str]]]:
    """Start tags with their attributes by local name; what a damaged document still gives."""
    parser = _Tags()
    try:
        parser.feed((data or b"").decode("utf-8", "replace"))
    except Exception:  # noqa: BLE001 - keep what was read
        pass
    return parser.found


def parse_package(content: Column) -> Column:
    """Manifest items and reading order of a package document; of items with one id the last counts."""

    @F.pandas_udf(_OPF)
    def parsed(blobs: pd.Series) -> pd.DataFrame:
        items, spines = [], []
        for blob in blobs:
            found = tags(blob)
            by_id = {a["id"]: unquote(a["href"]) for t, a in found if t == "item" and "id" in a and "href" in a}
            items.append([{"id": k, "href": v} for k, v in by_id.items()])
            spines.append([a["idref"] for t, a in found if t == "itemref" and "idref" in a])
        return pd.DataFrame({"items": items, "spine": spines})

    return parsed(content)


def image_references(content: Column) -> Column:
    """References of a document to images, in order."""

    @F.pandas_udf("array<string>")
    def found(blobs: pd.Series) -> pd.Series:
        def references(blob):
            return [unquote(a.get("src") or a.get("href") or "") for t, a in tags(blob) if t in ("img", "image") and (a.get("src") or a.get("href"))]

        return blobs.map(references)

    return found(content)


def epub_pages(entries: DataFrame) -> DataFrame:
    """Pages in reading order: src, page_ord, path, content.

    Joins the package's reading order to its manifest, documents and images by container path; a
    missing item, document or image is skipped, of several images the largest is taken, the first on a
    tie.  Sources whose package leads to no image give no rows (read them as plain archives).
    """
    files = entries.where(F.col("name").isNotNull() & ~F.coalesce("is_dir", F.lit(False))).select("src", F.regexp_replace("name", r"^/+", "").alias("path"), "content")
    packages = files.where(extension(F.col("path")) == "opf").groupBy("src").agg(F.min_by(F.struct("path", "content"), "path").alias("p"))
    opf = packages.select("src", parent(F.col("p.path")).alias("base"), parse_package(F.col("p.content")).alias("o"))
    spine = opf.select("src", "base", "o.items", F.posexplode("o.spine").alias("spine_pos", "idref"))
    href = F.filter("items", lambda i: i["id"] == F.col("idref"))[0]["href"]
    documents = spine.select("src", "spine_pos", resolve_relative(F.col("base"), href).alias("path")).where("path is not null")
    bodies = documents.join(files, ["src", "path"]).select("src", "spine_pos", parent(F.col("path")).alias("base"), F.posexplode(image_references(F.col("content"))).alias("ref_pos", "ref"))
    images = bodies.select("src", "spine_pos", "ref_pos", resolve_relative(F.col("base"), F.col("ref")).alias("path"))
    sizes = files.select("src", "path", F.octet_length("content").alias("bytes"))
    # Only sizes go through the choice; bytes are joined back last.
    best = images.join(sizes, ["src", "path"]).groupBy("src", "spine_pos").agg(F.min(F.struct((-F.col("bytes")).alias("less"), "ref_pos", "path")).alias("b"))
    return best.select("src", F.col("spine_pos").alias("page_ord"), F.col("b.path").alias("path")).join(files, ["src", "path"]).select("src", "page_ord", "path", "content")


_FIELDS = {"Series": "series", "Volume": "volume", "Number": "number", "Summary": "summary", "Title": "title", "Writer": "writers", "Penciller": "pencillers", "Inker": "inkers", "Colorist": "colorists"}
COMIC_INFO = "struct<" + ",".join(f"{name}:string" for name in _FIELDS.values()) + ",bookmarks:array<struct<image:int,title:string>>>"


def comic_info(data: bytes | None) -> dict | None:
    """Fields of a ComicInfo document: the first of each name at any depth; None if it is malformed."""
    try:
        root = ElementTree.fromstring(data or b"")
    except ElementTree.ParseError:
        return None
    out: dict = dict.fromkeys(_FIELDS.values())
    out["bookmarks"] = []
    for node in root.iter():
        name = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
        if name in _FIELDS and out[_FIELDS[name]] is None:
            out[_FIELDS[name]] = (node.text or "").strip()
        elif name == "Page" and node.get("Bookmark") and re.fullmatch(r"\+?\d{1,9}", node.get("Image", "")):
            out["bookmarks"].append({"image": int(node.get("Image")), "title": node.get("Bookmark")})
    return out


def parse_comic_info(content: Column) -> Column:
    """Metadata of a ComicInfo document; null if it is malformed (the whole document is then ignored)."""

    @F.pandas_udf(COMIC_INFO)
    def parsed(blobs: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys([*_FIELDS.values(), "bookmarks"])
        return pd.DataFrame([comic_info(b) or empty for b in blobs], columns=list(empty))

    out = parsed(content)
    return F.when(out["bookmarks"].isNotNull(), out)
