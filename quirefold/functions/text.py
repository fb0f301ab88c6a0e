"""Names, paths and titles as Spark expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds by extension.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif", "avif")
BOOK_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp")
ARCHIVE_KINDS = {"zip": "zip", "cbz": "zip", "rar": "rar", "cbr": "rar", "7z": "7z", "cb7": "7z", "tar": "tar", "cbt": "tar"}
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}
_OUTER = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def trim_all(text: Column) -> Column:
    """Without outer white space of any kind; Spark's own trim takes blanks only."""
    return F.regexp_replace(text, _OUTER, "")


def normalize_path(name: Column) -> Column:
    """Entry path with ``/`` between clean parts; null if nothing is left.

    Parts that are empty, ``.``, ``..`` or a drive are dropped; trailing colons are stripped, and what
    that uncovers is looked at again, so that no part can climb out of a folder.
    """
    parts = F.split(name, r"[/\\]")
    trimmed = F.transform(parts, trim_all)
    no_drive = F.filter(trimmed, lambda p: ~((F.octet_length(p) == 2) & p.endswith(":")))
    bare = F.transform(no_drive, lambda p: trim_all(F.regexp_replace(p, r":+$", "")))
    kept = F.filter(bare, lambda p: (p != "") & (p != ".") & (p != ".."))
    return F.nullif(F.array_join(kept, "/"), F.lit(""))


def safe_join(base: Column, name: Column) -> Column:
    """The normalised path under a folder; the folder itself if nothing is left of it."""
    return F.concat_ws("/", base, normalize_path(name))


def is_directory(name: Column, flag: Column) -> Column:
    """Directory entry: so flagged, or spelt with a separator at the end."""
    return F.coalesce(flag, F.lit(False)) | name.rlike(r"[/\\]$")


def base_name(path: Column) -> Column:
    """The last part of a path with either separator."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent(path: Column) -> Column:
    """All but the last part of a normalised path; empty at the root."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def depth(path: Column) -> Column:
    """Number of parts of a normalised path."""
    return F.size(F.split(path, "/"))


def extension(path: Column) -> Column:
    """Small-letter extension; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r".\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """Base name without its extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def is_junk(name: Column) -> Column:
    """Files that operating systems leave behind."""
    base = base_name(name)
    return F.exists(F.split(name, r"[/\\]"), lambda p: p == "__MACOSX") | base.startswith("._") | F.lower(base).isin(".ds_store", "thumbs.db")


def is_image(name: Column) -> Column:
    """Any image file."""
    return extension(name).isin(*IMAGE_EXTENSIONS)


def is_book_image(name: Column) -> Column:
    """An image file that pages are made of."""
    return extension(name).isin(*BOOK_EXTENSIONS)


def is_metadata(name: Column) -> Column:
    """The metadata file of a book."""
    return base_name(name) == "ComicInfo.xml"


def media_type(ext: Column) -> Column:
    """Media type of an extension; null if it isn't a page's."""
    out = F.lit(None).cast("string")
    for key, value in MEDIA_TYPES.items():
        out = F.when(ext == key, value).otherwise(out)
    return out


def archive_kind(ext: Column) -> Column:
    """Container kind of a target spelling, with or without a dot and in any case; null if unknown."""
    bare = F.lower(F.regexp_replace(ext, r"^\.+", ""))
    out = F.lit(None).cast("string")
    for key, value in ARCHIVE_KINDS.items():
        out = F.when(bare == key, value).otherwise(out)
    return F.when(bare == "dir", "dir").otherwise(out)


def matches_root(root: Column, *candidates: Column) -> Column:
    """Whether the letters and digits of a root and of a candidate contain each other; nothing matches an empty one."""

    def bare(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))

    own = bare(root)
    out = F.lit(False)
    for candidate in candidates:
        other = bare(candidate)
        out = out | F.coalesce((own != "") & (other != "") & (F.contains(other, own) | F.contains(own, other)), F.lit(False))
    return out


def natural_key(name: Column, fold_case: bool = True) -> Column:
    """A string whose plain order is the natural order of names: runs of digits compare as numbers.

    White space doesn't count.  A run that starts with 0 compares digit by digit, before one that
    doesn't.  Ties are for the caller to break by the name itself.
    """
    text = F.lower(name) if fold_case else name
    runs = F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    keyed = F.transform(
        runs,
        lambda t: F.when(t.rlike("^0"), F.concat(F.lit("0"), t, F.lit("\u0001"))).when(t.rlike("^[1-9]"), F.concat(F.lit("1"), F.lpad(F.length(t).cast("string"), 4, "0"), t)).otherwise(t),
    )
    return F.concat_ws("", keyed)


def folder_key(folder: Column) -> Column:
    """Sort key of folders in pre-order: a folder before what is in it, siblings in natural order."""
    return F.when(folder == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(folder, "/"), lambda p: natural_key(p)))


def pad_numbers(value: Column) -> Column:
    """The first two runs of digits padded with zeros to four places."""
    both = F.regexp_replace(value, r"^([^0-9]*)([0-9]+)([^0-9]+)([0-9]+)", "$10000$2$30000$4")
    one = F.regexp_replace(value, r"^([^0-9]*)([0-9]+)", "$10000$2")
    return F.regexp_replace(F.when(value.rlike(r"[0-9][^0-9]+[0-9]"), both).otherwise(one), r"0*([0-9]{4,})", "$1")


def slug(value: Column) -> Column:
    """Small letters and digits with single hyphens between them; other scripts' letters act as separators."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def word_name(name: Column) -> Column:
    """Runs of what isn't a letter, digit or underscore as one underscore."""
    return F.regexp_replace(name, r"(?U)\W+", "_")


def strip_fusion_prefix(name: Column) -> Column:
    """Without the order prefix that fused sources get."""
    return F.regexp_replace(name, r"^fusion_\d{4}_", "")


def zfill(value: Column, width: int) -> Column:
    """Zeros in front, behind a sign; never cuts."""
    sign = F.regexp_extract(value, r"^([+-]?)", 1)
    rest = F.regexp_replace(value, r"^[+-]", "")
    missing = F.greatest(F.lit(width) - F.length(value), F.lit(0))
    return F.concat(sign, F.repeat(F.lit("0"), missing), rest)


def html_escape(value: Column) -> Column:
    """The five reserved characters as references."""
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(plain), F.lit(reference))
    return value


def normalize_line_ends(value: Column) -> Column:
    """Line feeds only."""
    return F.replace(F.replace(value, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def book_title(default: Column, series: Column, volume: Column, number: Column, title: Column, combine: bool = False) -> Column:
    """``Series Vol. 03 #007: Title`` from what is there; empty and null parts are left out."""

    def has(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    out = F.when(has(series), series).otherwise(default)
    out = F.concat(out, F.when(has(volume), F.concat(F.lit(" Vol. "), zfill(volume, 2))).otherwise(""))
    out = F.concat(out, F.when(has(number), F.concat(F.lit(" #"), zfill(number, 3))).otherwise(""))
    return F.concat(out, F.when(has(title), F.concat(F.lit(": "), title)).otherwise("")) if combine else out


def shard_title(base: Column, ordinal: Column, total: Column) -> Column:
    """``Base [2/3]``, with two places each if there are more than nine."""
    long = F.format_string("%s [%02d/%02d]", base, ordinal.cast("int"), total.cast("int"))
    return F.when(total > 9, long).otherwise(F.format_string("%s [%d/%d]", base, ordinal.cast("int"), total.cast("int")))


def group_position(volume: Column, number: Column) -> Column:
    """``volume.number`` of what is there; null if nothing is."""
    return F.nullif(F.concat_ws(".", F.nullif(volume, F.lit("")), F.nullif(number, F.lit(""))), F.lit(""))


def page_name(ordinal: Column) -> Column:
    """``cb-0007``."""
    return F.format_string("cb-%04d", ordinal.cast("int"))


def resolve_relative(base: Column, reference: Column) -> Column:
    """A reference resolved against a folder; ``..`` stops at the root, a leading slash starts there."""
    folded = F.replace(reference, F.lit("\\"), F.lit("/"))
    start = F.when(folded.startswith("/"), F.array().cast("array<string>")).otherwise(F.filter(F.split(base, "/"), lambda p: p != ""))
    steps = F.concat(start, F.filter(F.split(folded, "/"), lambda p: (p != "") & (p != ".")))

    def walk(path: Column, step: Column) -> Column:
        up = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when(step == "..", up).otherwise(F.concat(path, F.array(step)))

    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/")


def people(*fields: Column) -> Column:
    """All names of comma-separated fields, distinct and sorted; ``cb`` where there are none."""
    parts = [F.filter(F.split(F.coalesce(f, F.lit("")), ", "), lambda p: p != "") for f in fields]
    found = F.array_sort(F.array_distinct(F.concat(*parts)))
    return F.when(F.size(found) == 0, F.array(F.lit("cb"))).otherwise(found)


def thousands(value: Column) -> Column:
    """Digits in groups of three."""
    return F.format_number(value, 0)


def modified_stamp(moment: Column) -> Column:
    """Second-precise UTC stamp."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
