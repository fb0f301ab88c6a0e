"""Sizes of images from their headers, and JPEG streams inside other files; no pixel is decoded."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Raw JPEG streams shorter than this are no pages; distance within which a stream's marks are looked for.
LEAST_JPEG, NEAR = 300, 20


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, BMP, JPEG or WebP image; None if the header doesn't tell."""
    if not data:
        return None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:2] == b"\xff\xd8":
            return _jpeg_size(data)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp_size(data)
    except struct.error:
        return None
    return None


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif mark in (0x01, *range(0xD0, 0xD8)):
            at += 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _webp_size(data: bytes) -> tuple[int, int] | None:
    form = data[12:16]
    if form == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if form == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if form == b"VP8 ":
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def image_size(content: Column) -> Column:
    """(width, height) of an image; null where the header doesn't tell."""

    @F.pandas_udf("struct<width:int,height:int>")
    def sizes(blobs: pd.Series) -> pd.DataFrame:
        found = [size_of(b) or (None, None) for b in blobs]
        return pd.DataFrame({"width": pd.array([w for w, _ in found], dtype="Int32"), "height": pd.array([h for _, h in found], dtype="Int32")})

    out = sizes(content)
    return F.when(out["width"].isNotNull(), out)


def jpeg_streams(data: bytes) -> list[bytes]:
    """JPEG images in the stream objects of a file, in order."""
    out, at = [], 0
    while (start := data.find(b"stream", at)) >= 0:
        if data[max(0, start - 3) : start] == b"end":
            at = start + 6
            continue
        first = data.find(b"\xff\xd8", start, start + NEAR)
        if first < 0:
            at = start + NEAR
            continue
        end = data.find(b"endstream", start)
        last = data.find(b"\xff\xd9", max(first, end - NEAR)) if end >= 0 else -1
        if last < 0:
            break
        if last + 2 - first >= LEAST_JPEG:
            out.append(data[first : last + 2])
        at = last + 2
    return out


def raw_jpegs(content: Column) -> Column:
    """JPEG streams of a file as an array."""

    @F.pandas_udf("array<binary>")
    def found(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: jpeg_streams(b) if b else [])

    return found(content)
