"""Names of outputs, parts of books and their references, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.text import ARCHIVE_KINDS, MEDIA_TYPES, base_name, extension, parent, stem, word_name

# Letters of the places that parts of a page take, and suffixes of books.
ORDER_LETTERS = {"normal": "x", "rotated_first": "a", "rotated_last": "d", "first_half": "b", "second_half": "c"}
BOOK_SUFFIX = {"epub": ".epub", "kepub": ".kepub.epub", "kepub_short": ".kepub", "cbz": ".cbz", "pdf": ".pdf"}


def strip_prefix(path: Column, root: Column) -> Column:
    """A path below a root, by whole parts; null if it isn't below it or is the root itself."""
    below = F.substring(path, F.length(root) + 2, F.length(path))
    return F.when((root != "") & F.startswith(path, F.concat(root, F.lit("/"))), F.nullif(below, F.lit("")))


def default_title(source: Column, is_dir: Column) -> Column:
    """Title of a source without metadata: the name of a folder, or of a file without its extension."""
    return F.when(F.coalesce(is_dir, F.lit(False)), base_name(source)).otherwise(stem(source))


def beside(source: Column, name: Column) -> Column:
    """A name in the folder of a source."""
    return F.concat_ws("/", F.nullif(parent(source), F.lit("")), name)


def converted_name(source: Column, is_dir: Column, target: str) -> Column:
    """Where a container goes in another format: beside itself; ``dir`` has no extension."""
    title = default_title(source, is_dir)
    return beside(source, title if target == "dir" else F.concat(title, F.lit(f".{target}")))


def already_in(kind: Column, target: str) -> Column:
    """Whether a container of a kind need not be converted to a format; folders are only like folders."""
    return F.coalesce(kind == ("dir" if target == "dir" else ARCHIVE_KINDS[target]), F.lit(False))


def book_name(source: Column, is_dir: Column, kind: str, tome: Column, wanted: Column) -> Column:
    """Where a book goes: ``wanted`` if it has the book's suffix, a folder ``wanted``, or beside the source.

    ``tome`` is what follows the name of a part of a book, empty for whole ones.  Names for readers with
    few characters keep letters and digits only.
    """
    suffix = F.lit(BOOK_SUFFIX[kind])
    title = default_title(source, is_dir)
    plain = F.when(F.coalesce(is_dir, F.lit(False)), title).otherwise(word_name(title)) if kind.startswith("kepub") else title
    named = F.when(F.endswith(wanted, suffix), wanted).otherwise(F.concat(F.regexp_replace(wanted, "/+$", ""), F.lit("/"), title, tome, suffix))
    return F.when(F.coalesce(wanted, F.lit("")) != "", named).otherwise(beside(source, F.concat(plain, tome, suffix)))


def part_name(source: Column, media: Column, order: Column | None = None, half: Column | None = None) -> Column:
    """Name of a page, or of a part of one, in the folder of its source: the order's letter and the half follow the stem."""
    bare = F.regexp_replace(base_name(source), r"(?<=.)\.[^.]*$", "")
    marks = F.lit("") if order is None else F.concat(F.lit("-cb-"), order)
    ends = F.lit("") if half is None else F.coalesce(F.concat(F.lit("-"), half), F.lit(""))
    return beside(source, F.concat(bare, marks, ends, F.lit("."), media_extension(media)))


def media_extension(media: Column) -> Column:
    """The extension of a page's media type; null for others."""
    out = F.lit(None).cast("string")
    for ext, name in MEDIA_TYPES.items():
        if ext != "jpeg":
            out = F.when(media == name, ext).otherwise(out)
    return out


def order_letter(order: Column) -> Column:
    """The letter of a part's place; null if it is none."""
    out = F.lit(None).cast("string")
    for name, letter in ORDER_LETTERS.items():
        out = F.when(order == name, letter).otherwise(out)
    return out


def part_folder(kind: str, chapter: Column) -> Column:
    """Folder of a chapter's images or texts in a book."""
    return F.when(F.coalesce(chapter, F.lit("")) == "", F.lit(kind)).otherwise(F.concat(F.lit(f"{kind}/"), chapter))


def folded_id(value: Column) -> Column:
    """A path as an identifier."""
    return F.replace(value, F.lit("/"), F.lit("_"))


def unique_id(chapter: Column, name: Column) -> Column:
    """Identifier of a page in a book: its image's path without the extension."""
    return folded_id(F.concat_ws("/", part_folder("Images", chapter), stem(name)))


def below_id(page_id: Column) -> Column:
    """Identifier of the lower half that goes with an upper one."""
    return F.replace(page_id, F.lit("above"), F.lit("below"))


def container_path(path: Column) -> Column:
    """A path in a container: slashes only, no leading ``./`` or ``/``."""
    folded = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(folded, r"^(?:\./)+", ""), r"^/+", "")


def dotted_extension(path: Column) -> Column:
    """The extension with its dot, in its own case; empty if there is none."""
    return F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)


def target_format(value: Column) -> Column:
    """A target spelling without leading dots, in small letters, and its container kind; null if it is none."""
    bare = F.lower(F.regexp_replace(value, r"^\.+", ""))
    kind = F.when(bare == "dir", "dir")
    for name, container in ARCHIVE_KINDS.items():
        kind = kind.when(bare == name, container)
    return F.when(kind.isNotNull(), F.struct(bare.alias("extension"), kind.alias("kind")))


def source_kind(path: Column, is_dir: Column, sniffed: Column) -> Column:
    """What a source is: a folder, a document by its extension, or a container by its first bytes; null if nothing."""
    return F.when(F.coalesce(is_dir, F.lit(False)), "dir").when(extension(path).isin("epub", "pdf"), extension(path)).otherwise(sniffed)


def byte_place(content: Column, wanted: bytes) -> Column:
    """Position (from 0) of some bytes in others; -1 if they aren't there."""
    at = F.expr("0").cast("int")  # keeps the type where content is null
    digits = F.hex(content)
    # Pairs of digits keep the places even: a match across two bytes is none.
    pairs = F.regexp_replace(digits, "(..)", "$1 ")
    found = F.instr(pairs, F.lit(" ".join(f"{b:02X}" for b in wanted)))
    return F.when(content.isNotNull(), F.when(found > 0, ((found - 1) / 3).cast("int")).otherwise(at - 1))
