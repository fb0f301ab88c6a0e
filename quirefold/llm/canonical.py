"""One consistent form for text that looks the same.

A quick check finds the characters that can be unstable: what normalisation may change, invisible
and unusual blank characters, and letters of one script among those of another.  Only the segments
around them, widened to a boundary where normalisation starts afresh, are normalised; the rest of
a text is kept as it is and the canonical segments are spliced in.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-alike letters and the Latin letters they are taken for.
CYRILLIC_LOOKS = dict(zip("аеорсухіѕјһԁԛԝүАВЕКМНОРСТХІЅЈУҮԌԚԜ", "aeopcyxisjhdqwyABEKMHOPCTXISJYYGQW"))
GREEK_LOOKS = dict(zip("αιοντκρυχγΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϹͿ", "aiovtkpuxyABEZHIKMNOPTYXcCJ"))
LATIN_AS_CYRILLIC = {latin: cyrillic for cyrillic, latin in CYRILLIC_LOOKS.items() if cyrillic in "аеорсухіАВЕКМНОРСТХІУ"}
LATIN_AS_GREEK = {latin: greek for greek, latin in GREEK_LOOKS.items() if greek in "οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"}
# Characters that show nothing, and marks and blanks with a plain form.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff\ufe00\ufe0e\ufe0f"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
PLAIN = {"\u2019": "'", "\u2018": "'", "\u02bc": "'", "\u02b9": "'", "\u02c8": "'", "\u2032": "'", "\u201b": "'", "\uff07": "'", "\u00b4": "'", "`": "'", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2212": "-", "\ufe63": "-", "\uff0d": "-"}
#: Compatibility characters that are spellings of their own and stay.
_KEPT = set("\u00aa\u00ba\u00b2\u00b3\u00b9\u00bc\u00bd\u00be\u2122\u2116\u2026\u2103\u2109 \ufdfc\u338f\u339d\u339e\u00a9\u00ae\u2025\u2121\u3231")


def _ranges(codes: Sequence[int]) -> list[tuple[int, int]]:
    """Ascending code points as first and last of each unbroken stretch."""
    out: list[list[int]] = []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


def _quick_check() -> tuple[list[tuple[int, int]], frozenset[str]]:
    """The code points that normalisation may change or move, or that are unusual; and the starters that compose with what stands before.

    The former are those with a quick check (NFC, NFKC) other than Yes or a combining class other than 0.
    """
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    split = {c: [int(x, 16) for x in d.split()] for c in codes if (d := unicodedata.decomposition(chr(c))) and d[0] != "<"}
    seconds = {d[1] for c, d in split.items() if len(d) == 2 and unicodedata.normalize("NFC", "".join(map(chr, d))) == chr(c)}
    seconds.update(range(0x1161, 0x1176), range(0x11A8, 0x11C3))  # Hangul composes by rule
    unstable = {c for c in codes if c in seconds or unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c)) or not unicodedata.is_normalized("NFKC", chr(c))}
    unstable.update(range(0x1100, 0x1200), map(ord, INVISIBLE), map(ord, BLANKS), map(ord, PLAIN))
    return _ranges(sorted(unstable - set(map(ord, _KEPT - {" "})) - {0x20})), frozenset(chr(c) for c in seconds if not unicodedata.combining(chr(c)))


# What the quick check looks for; the same class runs on the JVM, where most rows end.
_RANGES, _JOINING = _quick_check()
_UNSTABLE = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _RANGES)


def needs_look(text: Column) -> Column:
    """Whether a text may be unstable: most are plain ASCII and settled by the first, cheapest test.

    Each test reads a text once; the class of the quick check comes last, for the JVM tries its ranges one by one.
    """
    odd = text.rlike(r"[`[^\x00-\x7f]]")
    mixed = text.rlike(r"[\p{IsCyrillic}\p{IsGreek}]") & text.rlike(r"\p{IsLatin}")
    return odd & (mixed | text.rlike(f"[`[^\\x00-\\x7f]&&[{_UNSTABLE}]]"))


_QUICK = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _RANGES) + "]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{Cf}]+(?:['’ʼʹ＇-][\p{L}\p{M}\p{Cf}]+)*")
_LATIN, _CYRILLIC, _GREEK = regex.compile(r"\p{Latin}"), regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{Greek}")
_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_JOINS = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}\p{Mongolian}]")
_PICTURE = regex.compile(r"\p{Extended_Pictographic}|[\U0001f3fb-\U0001f3ff\ufe0f]")


def _keeps(text: str, i: int) -> bool:
    """Whether an invisible character does something where it stands: it joins pictures, or shapes letters of a joining script."""
    ch = text[i]
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if ch in "\u200d\ufe0f\ufe0e":
        if before and _PICTURE.match(before) and (ch != "‍" or (after and _PICTURE.match(after))):
            return True
    return ch in "\u200c\u200d" and bool(before and _JOINS.match(before)) and bool(after and _JOINS.match(after))


@lru_cache(maxsize=65536)
def _compatible(ch: str, east: bool) -> str:
    """The plain form of one compatibility character."""
    if ch in _KEPT:
        return ch
    single = unicodedata.normalize("NFC", ch)
    if single in PLAIN:
        return PLAIN[single]
    code = ord(ch)
    if 0xFF01 <= code <= 0xFF5E and east and not ch.isalnum():
        return ch  # wide punctuation is at home in East Asian text
    plain = unicodedata.normalize("NFKC", ch)
    return plain if plain.strip() or ch.isspace() else ch


@lru_cache(maxsize=65536)
def _boundary(ch: str) -> bool:
    """Whether normalisation starts afresh before a character, also before what becomes of it."""
    return all(unicodedata.combining(c) == 0 and c not in _JOINING and not "\u1160" <= c <= "\u11ff" for c in (ch, _compatible(ch, False)[0]))


def canonical(text: str) -> str:
    """The consistent form: precomposed accents, ordinary blanks, the straight ' and -, one script in a word."""
    east = bool(_EAST.search(text))
    out: list[str] = []
    at = 0
    for m in _QUICK.finditer(text):
        i = m.start()
        if i < at:
            continue
        start = i
        while start > at and (not _boundary(text[start]) or text[start] in INVISIBLE):
            start -= 1  # a mark needs the letter before it, also behind what will vanish
        stop = i + 1
        while stop < len(text) and (not _boundary(text[stop]) or _QUICK.match(text[stop])):
            stop += 1
        out += [text[at:start], _canonical_segment(text, start, stop, east)]
        at = stop
    joined = "".join([*out, text[at:]])
    return _one_script(joined)


def _canonical_segment(text: str, start: int, stop: int, east: bool) -> str:
    chars = []
    for i in range(start, stop):
        ch = text[i]
        if ch in INVISIBLE:
            if _keeps(text, i):
                chars.append(ch)
        elif ch in BLANKS:
            chars.append(" ")
        elif ch in PLAIN:
            chars.append(PLAIN[ch])
        else:
            chars += [PLAIN.get(c, c) for c in _compatible(ch, east) if c == ch or c not in INVISIBLE]
    return unicodedata.normalize("NFC", "".join(chars))


def _swap(word: str, table: dict[str, str]) -> str:
    return "".join(table.get(ch, ch) for ch in word)


def _one_script(text: str) -> str:
    """Words of mixed script in the script of their other letters; whole words of look-alikes in that of their neighbours."""
    if not (_CYRILLIC.search(text) or _GREEK.search(text)) or not _LATIN.search(text):
        return text
    found = list(_WORD.finditer(text))
    # Mixed words are settled first; what they turn out to be counts for their neighbours.
    words = [_unmixed(m.group()) if _kind(m.group()) == "mixed" else m.group() for m in found]
    kinds = [_kind(word) for word in words]
    total = Counter(kinds)
    # Words of a kind that have a letter no other script shows.
    own = Counter(kind for word, kind in zip(words, kinds) if kind in _LOOKS and not _is_look_alike(word, _LOOKS[kind]))
    out, at = [], 0
    for m, word, kind in zip(found, words, kinds):
        if kind in _LOOKS and _is_look_alike(word, _LOOKS[kind]):
            if (total["latin"] or total["mixed"] or total[kind] > 1) and not own[kind] and (len(word) > 1 or kind == "cyrillic"):
                word = _swap(word, _LOOKS[kind])
        elif kind == "latin" and own["cyrillic"] and total["latin"] == 1 and not word.isupper() and all(ch in LATIN_AS_CYRILLIC for ch in word if ch.isalpha()):
            if len(word) > 1 or word in "acoyeABKOCY":
                word = _swap(word, LATIN_AS_CYRILLIC)
        out += [text[at : m.start()], word if word == m.group() else unicodedata.normalize("NFC", word)]
        at = m.end()
    return "".join([*out, text[at:]])


_LOOKS = {"cyrillic": CYRILLIC_LOOKS, "greek": GREEK_LOOKS}


def _is_look_alike(word: str, looks: dict[str, str]) -> bool:
    return all(ch in looks or not ch.isalpha() for ch in word)


def _kind(word: str) -> str:
    found = [name for name, pattern in (("latin", _LATIN), ("cyrillic", _CYRILLIC), ("greek", _GREEK)) if pattern.search(word)]
    return found[0] if len(found) == 1 else "mixed" if found else "other"


def _unmixed(word: str) -> str:
    """A mixed word in the one script that can write all of it; Latin where several can."""
    latin = _swap(_swap(word, CYRILLIC_LOOKS), GREEK_LOOKS)
    if not (_CYRILLIC.search(latin) or _GREEK.search(latin)):
        cyrillic = _swap(word, LATIN_AS_CYRILLIC)
        if not (_LATIN.search(cyrillic) or _GREEK.search(cyrillic)) and len(_CYRILLIC.findall(word)) > len(_LATIN.findall(word)):
            return cyrillic
        return latin
    cyrillic = _swap(word, LATIN_AS_CYRILLIC)
    if not (_LATIN.search(cyrillic) or _GREEK.search(cyrillic)):
        return cyrillic
    greek = _swap(word, LATIN_AS_GREEK)
    if not (_LATIN.search(greek) or _CYRILLIC.search(greek)):
        return greek
    return word


def canonical_fields(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Every value in its consistent form: key, field_name, original, plain, changed.

    Rows delivered twice count once.  Null values give no row; empty and blank ones are kept (a blank
    other than the ordinary one becomes it).  Stable values never leave the JVM.
    """
    stacked = df.select(F.col(key).alias("row_key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("original")) for f in fields])).alias("c"))
    cells = stacked.select("row_key", "c.*").where("original is not null").distinct()

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(canonical)

    quick = needs_look(F.col("original"))
    # A constant here lets a search for changed values leave this branch out.
    stable = cells.where(~quick).select("*", F.col("original").alias("plain"), F.lit(False).alias("changed"))
    unstable = cells.where(quick).select("*", plain("original").alias("plain")).withColumn("changed", F.col("plain") != F.col("original"))
    return stable.unionByName(unstable).select(F.col("row_key").alias(key), "field_name", "original", "plain", "changed")
