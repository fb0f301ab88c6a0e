"""Writing books into containers.

Rows are hashed by book and sorted inside their partitions; each container is streamed into a
temporary file beside its place and renamed when it is whole, so a task that is run again replaces
its own work and a reader never sees half a book.  The folder must be shared by all executors.
"""

from __future__ import annotations

import io
import os
import shutil
import tarfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirefold.functions.text import normalize_path

WRITTEN = "book string, path string, n_entries int, bytes long"
SUFFIX = {"zip": ".cbz", "tar": ".cbt", "dir": "", "epub": ".epub"}
_EPOCH = (1980, 1, 1, 0, 0, 0)


class _Zip:
    """A zip with stored members; each parent folder is registered once."""

    def __init__(self, place: str, folders: bool = True):
        self.archive, self.seen, self.folders = zipfile.ZipFile(place, "w", zipfile.ZIP_STORED), set(), folders

    def add(self, name: str, data: bytes | None) -> None:
        parts = name.split("/")
        for n in range(1, len(parts) + (data is None)) if self.folders else ():
            folder = "/".join(parts[:n]) + "/"
            if folder not in self.seen:
                self.seen.add(folder)
                self.archive.writestr(zipfile.ZipInfo(folder, _EPOCH), b"")
        if data is not None:
            self.archive.writestr(zipfile.ZipInfo(name, _EPOCH), data)

    def close(self) -> None:
        self.archive.close()


class _Tar:
    """A tar whose files have mode 0644 and folders 0755."""

    def __init__(self, place: str):
        self.archive = tarfile.open(place, "w")

    def add(self, name: str, data: bytes | None) -> None:
        info = tarfile.TarInfo(name)
        if data is None:
            info.type, info.mode = tarfile.DIRTYPE, 0o755
            self.archive.addfile(info)
        else:
            info.size, info.mode = len(data), 0o644
            self.archive.addfile(info, io.BytesIO(data))

    def close(self) -> None:
        self.archive.close()


class _Folder:
    def __init__(self, place: str):
        self.place = place
        os.makedirs(place)

    def add(self, name: str, data: bytes | None) -> None:
        full = os.path.join(self.place, *name.split("/"))
        os.makedirs(full if data is None else os.path.dirname(full), exist_ok=True)
        if data is not None:
            with open(full, "wb") as out:
                out.write(data)

    def close(self) -> None:
        pass


def _writer(kind: str, place: str):
    if kind == "zip":
        return _Zip(place)
    if kind == "epub":
        return _Zip(place, folders=False)
    if kind == "tar":
        return _Tar(place)
    if kind == "dir":
        return _Folder(place)
    raise ValueError(f"unsupported container: {kind}")


def _size(place: str) -> int:
    if os.path.isfile(place):
        return os.path.getsize(place)
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(place) for f in files)


def write_books(entries: DataFrame, folder: str, kind: str, book: str = "book_id", order: Sequence[str] = ("entry_ord",), name: str = "name", content: str = "content") -> DataFrame:
    """One container per book; the frame returned (book, path, n_entries, bytes) does the writing when it is evaluated.

    Names are normalised and entries whose name is nothing then are left out; a null content is a
    folder.  Slashes in a book's name are written as %2F, and a null book as %book, so no two books share a file.
    """
    _ = SUFFIX[kind] if kind in SUFFIX else _writer(kind, "")
    arrow = to_arrow_schema(StructType.fromDDL(WRITTEN))
    kept = entries.select(F.coalesce(F.replace(F.replace(F.col(book).cast("string"), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("%book")).alias("book"), *[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], normalize_path(F.col(name)).alias("name"), F.col(content).cast("binary").alias("content"))
    kept = kept.where("name is not null")
    n = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: str, place: str, count: int) -> pa.RecordBatch:
            target = os.path.join(folder, key + SUFFIX[kind])
            if os.path.isdir(target):
                shutil.rmtree(target)
            os.replace(place, target)
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((key, target, count, _size(target)), arrow)], schema=arrow)

        os.makedirs(folder, exist_ok=True)
        key, out, place, count = None, None, "", 0
        try:
            for batch in batches:
                for row in zip(*[column.to_pylist() for column in batch.columns]):
                    if row[0] != key:
                        if out is not None:
                            out.close()
                            yield done(key, place, count)
                        key, count = row[0], 0
                        place = os.path.join(folder, f".part-{uuid.uuid4().hex}")
                        out = _writer(kind, place)
                    out.add(row[1 + n], row[2 + n])
                    count += 1
            if out is not None:
                out.close()
                out = None
                yield done(key, place, count)
        finally:
            if place and os.path.exists(place):
                shutil.rmtree(place) if os.path.isdir(place) else os.remove(place)

    return kept.repartition("book").sortWithinPartitions("book", *[f"o{k}" for k in range(n)]).mapInArrow(run, WRITTEN)
