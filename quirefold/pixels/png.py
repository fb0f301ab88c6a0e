"""PNG with zlib and numpy: 8-bit gray, RGB, RGBA and palette images, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray, palette: np.ndarray | None = None, bits: int = 8) -> bytes:
    """An image (h, w) gray or indexed, or (h, w, 3) or (h, w, 4) colour, as PNG; indices take 1, 2, 4 or 8 bits."""
    pixels = np.ascontiguousarray(pixels, dtype=np.uint8)
    h, w = pixels.shape[:2]
    kind = 3 if palette is not None else {2: 0, 3: {1: 0, 3: 2, 4: 6}.get(pixels.shape[-1], 2)}[pixels.ndim]
    rows = pixels.reshape(h, -1)
    if bits < 8:
        per = 8 // bits
        rows = np.pad(rows, ((0, 0), (0, -w % per))).reshape(h, -1, per)
        shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * bits
        rows = np.bitwise_or.reduce(rows << shifts, axis=2).astype(np.uint8)
    raw = np.hstack([np.zeros((h, 1), np.uint8), rows]).tobytes()
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, 0))
    colours = _chunk(b"PLTE", np.asarray(palette, np.uint8).tobytes()) if palette is not None else b""
    return _SIGNATURE + head + colours + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """An image as (h, w) gray or (h, w, 3) RGB; palettes are resolved and alpha is dropped.  ValueError if it can't be read."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + length]
        at += 12 + length
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[6]:
        raise ValueError("no header, or interlaced")
    w, h, bits, kind = head[:4]
    if kind not in _CHANNELS or (bits != 8 and not (kind in (0, 3) and bits < 8)):
        raise ValueError(f"unsupported PNG: {bits} bits, kind {kind}")
    step = _CHANNELS[kind]
    width = -(-w * step * bits // 8)
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + width)
    except (zlib.error, ValueError) as e:
        raise ValueError(str(e)) from e
    rows = _unfilter(raw, max(1, step * bits // 8))
    if bits < 8:
        shifts = np.arange(8 // bits - 1, -1, -1, dtype=np.uint8) * bits
        rows = ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(h, -1)[:, :w]
        if kind == 0:
            rows = rows * (255 // ((1 << bits) - 1))
    if kind == 3:
        if palette is None:
            raise ValueError("palette is missing")
        return palette[np.minimum(rows, len(palette) - 1)]
    shaped = rows.reshape(h, w, step) if step > 1 else rows.reshape(h, w)
    return shaped[..., 0] if kind == 4 else shaped[..., :3] if kind == 6 else shaped


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, line in enumerate(raw):
        kind, row = line[0], line[1:].astype(np.int32)
        if kind == 1:
            for k in range(step):
                row[k::step] = np.cumsum(row[k::step])
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            up = above.astype(np.int32)
            for x in range(len(row)):
                a = row[x - step] if x >= step else 0
                if kind == 3:
                    row[x] = (row[x] + (a + up[x]) // 2) & 255
                else:
                    c = up[x - step] if x >= step else 0
                    p = a + up[x] - c
                    pa, pb, pc = abs(p - a), abs(p - up[x]), abs(p - c)
                    row[x] = (row[x] + (a if pa <= pb and pa <= pc else up[x] if pb <= pc else c)) & 255
        elif kind:
            raise ValueError(f"filter {kind}")
        out[y] = above = (row & 255).astype(np.uint8)
    return out
