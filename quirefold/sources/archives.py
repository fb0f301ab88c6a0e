"""Reading containers (zip, tar, folders) into rows of entries.

Each container is one row of a binary file scan, so containers are read in parallel and a lost
executor only costs a reread.  A container that can't be read gives one row with an error instead
of failing the job; ``strict`` raises.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirefold.functions.naming import strip_prefix
from quirefold.functions.text import base_name, extension, folder_key, is_book_image, is_directory, is_junk, is_metadata, natural_key, normalize_path, parent, stem
from quirefold.operators.ordering import number_rows, runs
from quirefold.session import written_table

ENTRIES = "src string, kind string, pos int, name string, is_dir boolean, content binary, error string"
#: Containers that no library here can read; they give an error row.
UNSUPPORTED = ("rar", "7z")


def sniff_kind(content: Column, path: Column) -> Column:
    """Kind of a container by its first bytes, then by its extension; null if unknown."""
    head = F.hex(F.substring(content, 1, 8))
    tar = F.hex(F.substring(content, 258, 5)) == "7573746172"
    by_name = extension(path)
    return (
        F.when(head.startswith("504B0304") | head.startswith("504B0506"), "zip")
        .when(head.startswith("526172211A07"), "rar")
        .when(head.startswith("377ABCAF271C"), "7z")
        .when(tar, "tar")
        .when(head.startswith("25504446"), "pdf")
        .when(by_name.isin("zip", "cbz", "epub"), "zip")
        .when(by_name.isin("tar", "cbt"), "tar")
        .when(by_name.isin("rar", "cbr"), "rar")
        .when(by_name.isin("7z", "cb7"), "7z")
    )


def read_container(src: str, kind: str | None, data: bytes, bodies: bool = True) -> Iterator[tuple]:
    """Rows of one container."""
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                for pos, info in enumerate(archive.infolist()):
                    yield src, kind, pos, info.filename, info.is_dir(), archive.read(info) if bodies and not info.is_dir() else None, None
        elif kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(data)) as archive:
                for pos, info in enumerate(m for m in archive if m.isfile() or m.isdir()):
                    yield src, kind, pos, info.name, info.isdir(), archive.extractfile(info).read() if bodies and info.isfile() else None, None
        else:
            yield src, kind, None, None, None, None, f"unsupported container: {kind or 'unknown'}"
    except Exception as e:  # noqa: BLE001 - whatever a damaged container makes the library raise
        yield src, kind, None, None, None, None, f"{type(e).__name__}: {e}"


def scan_containers(files: DataFrame, bodies: bool = True, strict: bool = False) -> DataFrame:
    """Entries of containers given as rows (path, content), as from a binary file scan.

    Columns: src, kind, pos, name, is_dir, content, error.  Without ``bodies`` only names are read.
    Null contents give an error row.
    """
    arrow = to_arrow_schema(StructType.fromDDL(ENTRIES))
    kinds = files.select(F.col("path").alias("src"), sniff_kind(F.col("content"), F.col("path")).alias("kind"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, kind, data in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                held, size = [], 0
                for row in read_container(src, kind, data or b"", bodies):
                    held.append(row)
                    size += len(row[5] or b"")
                    if size > 32_000_000 or len(held) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    entries = kinds.mapInArrow(run, ENTRIES)
    if strict:
        entries = entries.withColumn("name", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "src", "error"))).otherwise(F.col("name")))
    return entries


def read_archives(spark: SparkSession, path: str, bodies: bool = True, strict: bool = False) -> DataFrame:
    """Entries of all containers under a path or glob; the file scan passes empty files over."""
    return scan_containers(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"), bodies, strict)


def read_folder(spark: SparkSession, folder: str, bodies: bool = True) -> DataFrame:
    """Files under a folder as entries of one source, in natural order of their paths."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = "/" + folder.rstrip("/").split("://")[-1].lstrip("/")
    if folder.startswith("file:"):
        root = "/" + folder[5:].strip("/")
    name = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root) + "/", "")
    listed = files.select(F.lit(folder).alias("src"), F.lit("dir").alias("kind"), name.alias("name"), *(["content"] if bodies else []))
    pos = F.row_number().over(Window.partitionBy("src").orderBy(natural_key(F.col("name"), fold_case=False), "name")) - 1
    body = F.col("content") if bodies else F.lit(None).cast("binary")
    return listed.select("src", "kind", pos.alias("pos"), "name", F.lit(False).alias("is_dir"), body.alias("content"), F.lit(None).cast("string").alias("error"))


def stream_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Containers as they arrive in a folder: a streaming frame of entries."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return scan_containers(files.select("path", "content"))


def classify(entries: DataFrame) -> DataFrame:
    """Entries with a clean path and what they are: page, metadata, other or junk; error rows and nameless ones are left out."""
    clean = entries.where(F.col("name").isNotNull()).withColumn("path", normalize_path(F.col("name"))).where("path is not null")
    p = F.col("path")
    role = F.when(is_directory(F.col("name"), F.col("is_dir")), "folder").when(is_junk(p), "junk").when(is_metadata(p), "metadata").when(is_book_image(p), "page").otherwise("other")
    return clean.withColumn("role", role)


def pages_of(entries: DataFrame) -> DataFrame:
    """Pages of each source in reading order: src, chapter, chapter_ord, page_ord, path, content.

    A folder that all pages of a source share is stripped.  Chapters are runs of neighbouring pages of
    one folder after the natural sort, so folders that differ only in case can alternate.  Entries are
    unpacked once into the shared folder; only their names are sorted, and the bytes joined last.
    """
    clean = written_table(classify(entries).where("role = 'page'").select("src", "pos", "path", "content"))
    top = F.when(F.col("path").contains("/"), F.element_at(F.split("path", "/"), 1)).otherwise("")
    names = clean.select("src", "pos", "path", top.alias("top"))
    tops = names.groupBy("src").agg(F.min("top").alias("least"), F.max("top").alias("most"))
    shared = tops.where("least = most and least <> ''").select("src", F.col("least").alias("root"))
    bare = names.join(shared, "src", "left").withColumn("full", F.col("path")).withColumn("path", F.coalesce(strip_prefix(F.col("path"), F.col("root")), F.col("path")))
    keyed = bare.select("src", "pos", "full", "path", parent(F.col("path")).alias("chapter")).withColumn("folder", folder_key(F.col("chapter"))).withColumn("natkey", natural_key(base_name(F.col("path"))))
    marked = runs(keyed, ["src"], ["folder", "natkey", "path", "pos"], "chapter", "chapter_ord")
    placed = number_rows(marked, ["src"], ["folder", "natkey", "path", "pos"], "page_ord")
    placed = placed.select("src", "chapter", (F.col("chapter_ord") + 1).alias("chapter_ord"), F.col("page_ord").cast("int").alias("page_ord"), "path", F.col("pos").alias("_pos"), "full")
    body = clean.select(F.col("src").alias("_src"), F.col("pos").alias("_p"), F.col("path").alias("_full"), "content")
    met = placed.join(body, (F.col("src") == F.col("_src")) & F.col("_pos").eqNullSafe(F.col("_p")) & (F.col("full") == F.col("_full")))
    return met.select("src", "chapter", "chapter_ord", "page_ord", "path", "content")


def book_names(sources: DataFrame, src: str = "src") -> DataFrame:
    """A name for each source (src, book_id): its file's stem, with a number behind it from the second source of that stem on."""
    each = sources.select(F.col(src).alias("src")).where("src is not null").distinct().withColumn("stem", stem(base_name(F.col("src"))))
    placed = number_rows(each, ["stem"], ["src"], "k")
    # A stem that looks like a numbered one gets a number as well, so no two names can be equal.
    numbered = F.format_string("%s~%d", "stem", "k")
    return placed.select("src", F.when((F.col("k") == 1) & ~F.col("stem").rlike(r"~\d+$"), F.col("stem")).otherwise(numbered).alias("book_id"))


def comic_infos(entries: DataFrame) -> DataFrame:
    """The metadata document of each source: src, content; of several the one nearest the root."""
    found = classify(entries).where("role = 'metadata'").select("src", "content", F.struct(F.size(F.split("path", "/")), "path", "pos").alias("at"))
    return found.groupBy("src").agg(F.min_by("content", "at").alias("content"))
