"""Pages of sources of any kind: containers, EPUB files, documents with embedded pictures."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirefold.functions.naming import source_kind
from quirefold.sources.archives import UNSUPPORTED, pages_of, read_archives, scan_containers, sniff_kind
from quirefold.sources.epub import epub_pages
from quirefold.sources.headers import raw_jpegs

LISTED = "src string, kind string, pos int, name string, is_dir boolean, error string"


def load_pages(spark: SparkSession, path: str, plain: bool = False, strict: bool = False) -> DataFrame:
    """Pages of everything under a path: src, kind, chapter, chapter_ord, page_ord, path, content, error.

    What a file is goes by its extension for EPUB and PDF files and by its first bytes for the rest.  An
    EPUB gives the pictures of its reading order; one without any (or with ``plain``) is read like any
    other container.  A PDF gives the JPEG pictures embedded in it.  A source that can't be read or has
    no page gives one row with an error; with ``strict`` that raises.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = files.withColumn("kind", source_kind(F.col("path"), F.lit(False), sniff_kind(F.col("content"), F.col("path"))))
    names = kinds.select(F.col("path").alias("src"), "kind")
    entries = scan_containers(kinds.where("kind is null or kind <> 'pdf'").select("path", "content"))
    read = entries.where("error is null")
    none = spark.createDataFrame([], "src string")
    documents = none
    out = []
    if not plain:
        books = read.join(names.where("kind = 'epub'").select("src"), "src", "left_semi")
        found = epub_pages(books).withColumn("chapter", F.lit("")).withColumn("chapter_ord", F.lit(1).cast("long"))
        documents = found.select("src").distinct()
        out.append(found.select("src", "chapter", "chapter_ord", F.col("page_ord").cast("int").alias("page_ord"), "path", "content"))
    out.append(pages_of(read.join(documents, "src", "left_anti")))
    pictures = kinds.where("kind = 'pdf'").select(F.col("path").alias("src"), F.posexplode(raw_jpegs(F.col("content"))).alias("k", "content"))
    out.append(pictures.select("src", F.lit("").alias("chapter"), F.lit(1).cast("long").alias("chapter_ord"), (F.col("k") + 1).alias("page_ord"), F.format_string("%05d.jpg", F.col("k") + 1).alias("path"), "content"))
    pages = out[0]
    for more in out[1:]:
        pages = pages.unionByName(more)
    errors = entries.where("error is not null").select("src", "error")
    missing = names.join(pages.select("src").distinct(), "src", "left_anti").join(errors, "src", "left").select("src", "kind", F.coalesce("error", F.when(F.col("kind").isin(*UNSUPPORTED), F.lit("unsupported container")), F.lit("no pages")).alias("error"))
    if strict:
        missing = missing.withColumn("error", F.raise_error(F.concat_ws(": ", "src", "error")))
    return pages.join(names, "src").withColumn("error", F.lit(None).cast("string")).unionByName(missing, allowMissingColumns=True)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """Names in all containers under a path, without their bodies: src, kind, pos, name, is_dir, error.

    Files are listed without being read; each task then opens its files in place and seeks: of a zip it
    reads the directory at the end, of a tar the header before each body.
    """
    arrow = to_arrow_schema(StructType.fromDDL(LISTED))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src in batch.column(0).to_pylist():
                rows = list(_listed(src))
                for at in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[at : at + 5000]), arrow)], schema=arrow)

    return files.select("path").mapInArrow(run, LISTED)


def _listed(src: str) -> Iterator[tuple]:
    from pyarrow import fs

    kind = None
    try:
        system, place = fs.FileSystem.from_uri(src)
        with system.open_input_file(place) as file:
            head = file.read(262)
            file.seek(0)
            raw = io.BufferedReader(pa.PythonFile(file, mode="r")) if not hasattr(file, "readinto") else file
            if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
                kind = "zip"
                for pos, info in enumerate(zipfile.ZipFile(raw).infolist()):
                    yield src, kind, pos, info.filename, info.is_dir(), None
            elif head[257:262] == b"ustar":
                kind = "tar"
                with tarfile.open(fileobj=raw) as archive:
                    for pos, info in enumerate(m for m in archive if m.isfile() or m.isdir()):
                        yield src, kind, pos, info.name, info.isdir(), None
            else:
                yield src, kind, None, None, None, "unsupported container"
    except Exception as e:  # noqa: BLE001 - whatever a damaged container makes the library raise
        yield src, kind, None, None, None, f"{type(e).__name__}: {e}"


__all__ = ["list_archives", "load_pages", "read_archives"]
