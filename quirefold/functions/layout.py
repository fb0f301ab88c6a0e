"""Sizes, crops, panels and reading direction of devices and strips, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of strips and covers, in pixels, and of shards, in bytes.
NARROWEST_STRIP, LOWEST_PAGE, TALLEST_STRIP, COVER_LIMIT = 300, 15, 131_072 * 4, 1920
MEBIBYTE, SHARD_MIB, STRIP_SHARD_MIB = 1024 * 1024, 400, 100
# Least sizes that the ways of clamping accept, and the ways each rule is for.
CLAMP_FLOOR = {"split": 500_000, "resize": 500_000, "max-width": 400}
CLAMP_LABEL = {"split": "'split' or 'resize'", "resize": "'split' or 'resize'", "max-width": "'max-width'"}
# Regions of a magnified page, and the order in which they are shown.
REGIONS = {"quadrants": ("PV-TL", "PV-TR", "PV-BL", "PV-BR"), "stacked": ("PV-T", "PV-B"), "side": ("PV-L", "PV-R")}
SHOWN = {
    ("quadrants", "upright", "ltr"): (1, 2, 3, 4), ("quadrants", "upright", "rtl"): (2, 1, 4, 3), ("quadrants", "rotated", "ltr"): (2, 4, 1, 3), ("quadrants", "rotated", "rtl"): (1, 3, 2, 4),
    ("stacked", "upright", "ltr"): (1, 2), ("stacked", "upright", "rtl"): (1, 2), ("stacked", "rotated", "ltr"): (2, 1), ("stacked", "rotated", "rtl"): (1, 2),
    ("side", "upright", "ltr"): (1, 2), ("side", "upright", "rtl"): (2, 1), ("side", "rotated", "ltr"): (1, 2), ("side", "rotated", "rtl"): (1, 2),
}
# The corners' places; the others are centred by a share of the screen.
_PLACES = {
    "PV-TL": "position:absolute;left:0;top:0;", "PV-TR": "position:absolute;right:0;top:0;", "PV-BL": "position:absolute;left:0;bottom:0;", "PV-BR": "position:absolute;right:0;bottom:0;",
    "PV-T": "position:absolute;top:0;left:%d%%;", "PV-B": "position:absolute;bottom:0;left:%d%%;", "PV-L": "position:absolute;left:0;top:%d%%;", "PV-R": "position:absolute;right:0;top:%d%%;",
}


def _d(c: Column) -> Column:
    return c.cast("double")


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))


def cover_size(W: Column, H: Column, limited: bool = False) -> Column:
    """Size of a cover: the frame, for some devices with both sides limited."""
    return _size(F.least(W, F.lit(COVER_LIMIT)), F.least(H, F.lit(COVER_LIMIT))) if limited else _size(W, H)


def enlarged(W: Column, H: Column, factor: float = 1.5) -> Column:
    """A frame enlarged for magnified panels (truncated)."""
    return _size(_d(W) * factor, _d(H) * factor)


def kept_crop(box: Column, w: Column, h: Column, least: float = 0.0, margin: float | None = None) -> Column:
    """A crop box with a share (per cent) of each margin kept, its edges rounded half to even; null if it leaves less than ``least`` of the page."""
    left, top, right, bottom = (_d(box[c]) for c in ("left", "top", "right", "bottom"))
    if margin is not None:
        keep = 1.0 - margin / 100.0
        left, top = left * keep, top * keep
        right, bottom = right + (_d(w) - right) * (1.0 - keep), bottom + (_d(h) - bottom) * (1.0 - keep)
    area = _d(w) * _d(h)
    edges = F.struct(*[F.rint(c).cast("long").alias(n) for n, c in (("left", left), ("top", top), ("right", right), ("bottom", bottom))])
    return F.when((area > 0) & ((right - left) * (bottom - top) / F.nullif(area, F.lit(0.0)) >= least), edges)


def clipped(start: Column, stop: Column, extent: Column) -> Column:
    """A half-open range cut to [0, extent); empty at its start if nothing is left."""
    low = F.greatest(start, F.lit(0))
    return F.struct(low.cast("long").alias("start"), F.greatest(low, F.least(stop, extent)).cast("long").alias("stop"))


def box_area(box: Column) -> Column:
    """Area of a half-open box; 0 if it is empty or reversed."""
    return (F.greatest(box["right"] - box["left"], F.lit(0)) * F.greatest(box["bottom"] - box["top"], F.lit(0))).cast("long")


def spread(low: Column, high: Column) -> Column:
    """Extent of a range of samples; 0 if it is reversed."""
    return F.greatest(high - low, F.lit(0))


def is_degenerate(low: Column, high: Column) -> Column:
    """Whether a range of samples has no extent, so that it can't be stretched."""
    return high <= low


def strip_pads(width: Column) -> Column:
    """Padding of a strip: rows (v, an even eightieth of the width), columns (h, a twentieth) and rows of a step; null if it is too narrow."""
    eightieth = F.floor(width / 80).cast("long")
    v = eightieth + F.pmod(eightieth, F.lit(2))
    pads = F.struct(v.alias("v"), F.floor(width / 20).cast("long").alias("h"), F.floor(v / 2).cast("long").alias("step"))
    return F.when(width >= NARROWEST_STRIP, pads)


def render_size(W: Column, H: Column, crops: str = "off") -> Column:
    """Size at which a page is drawn, larger where its margins are to be cropped."""
    factor = {"off": 1.0, "margins": 1.2, "numbers": 1.25}[crops]
    return F.struct((_d(W) * factor).alias("width"), (_d(H) * factor).alias("height"))


def render_zoom(target: Column, w: Column, h: Column, by_width: bool = False) -> Column:
    """Zoom of a page: by its height, or by its width if that is asked for and it is not wider than tall; 1 for a page without extent."""
    tall, wide = target["height"] / F.nullif(_d(h), F.lit(0.0)), target["width"] / F.nullif(_d(w), F.lit(0.0))
    use_height = F.lit(not by_width) | (w > h)
    return F.when(use_height & (h > 0), tall).when(w > 0, wide).otherwise(F.lit(1.0))


def shard_bytes(mib: Column, strips: bool = False) -> Column:
    """Size of a shard in bytes, with the default of the kind of book for null."""
    return F.coalesce(mib, F.lit(STRIP_SHARD_MIB if strips else SHARD_MIB)).cast("long") * MEBIBYTE


def panel_offset(device: Column, size: Column) -> Column:
    """Per cent of the screen by which a centred part begins outside of it (truncated twice)."""
    inner = (_d(device) / 2 - _d(size) / 2).cast("long")
    return (_d(inner) / F.nullif(_d(device), F.lit(0.0)) * 100).cast("long")


def magnified(w: Column, h: Column, W: Column, H: Column, mode: str = "whole") -> Column:
    """Size of a page in the magnified view: half as large again, across the screen ('two') or as it is ('fine')."""
    if mode == "two":
        return _size(W, _d(W) / F.nullif(_d(w), F.lit(0.0)) * _d(h))
    return _size(w, h) if mode == "fine" else enlarged(w, h)


def panel_grid(size: Column, W: Column, H: Column) -> Column:
    """Which parts of a magnified page are shown: a screen it hardly exceeds in one direction isn't divided in that one."""
    across, down = _d(size["width"]) - _d(W) < _d(W) * 0.01, _d(size["height"]) - _d(H) < _d(H) * 0.01
    return F.when(across & down, "none").when(across, "stacked").when(down, "side").otherwise("quadrants")


def panel_regions(size: Column, W: Column, H: Column, rotated: Column, right_to_left: bool = False) -> Column:
    """Regions (id, ordinal, style) of a magnified page, as an array in their own order."""
    x, y = panel_offset(W, size["width"]), panel_offset(H, size["height"])
    grid = panel_grid(size, W, H)
    out = F.array().cast("array<struct<id:string,ordinal:int,style:string>>")
    for (name, turn, way), order in SHOWN.items():
        if way != ("rtl" if right_to_left else "ltr"):
            continue
        regions = []
        for id_, place in zip(REGIONS[name], order):
            style = F.format_string(_PLACES[id_], x if id_ in ("PV-T", "PV-B") else y) if "%d" in _PLACES[id_] else F.lit(_PLACES[id_])
            regions.append(F.struct(F.lit(id_).alias("id"), F.lit(place).alias("ordinal"), style.alias("style")))
        out = F.when((grid == name) & (F.coalesce(rotated, F.lit(False)) == (turn == "rotated")), F.array(*regions)).otherwise(out)
    return out


def direction(right_to_left: Column, inverted: Column) -> Column:
    """Page progression: right to left if just one of the two is set."""
    return F.when(right_to_left != inverted, "rtl").otherwise("ltr")


def opposite(side: Column) -> Column:
    """The other side; the centre stays."""
    return F.when(side == "left", "right").when(side == "right", "left").otherwise(side)


def opening_side(progression: Column, source: Column, shifted: bool = False) -> Column:
    """Side of the first page; documents that have pages of their own begin on the other one, and so do shifted books."""
    side = F.when(progression == "rtl", "right").otherwise("left")
    side = F.when(F.lower(source).rlike(r"\.(pdf|epub)$"), opposite(side)).otherwise(side)
    return opposite(side) if shifted else side


def writing_mode(vertical: Column, progression: Column) -> Column:
    """The writing mode of a book."""
    return F.concat(F.when(vertical, "vertical").otherwise("horizontal"), F.when(progression == "rtl", "-rl").otherwise("-lr"))


def spine_property(side: Column, family: str = "kindle") -> Column:
    """The attributes of a page's place in the reading order, as the family of readers spells them."""
    return F.format_string('linear="yes" properties="page-spread-%s"' if family == "kindle" else 'properties="rendition:page-spread-%s"', side)


def bin_frequency(index: Column, length: int) -> Column:
    """Cycles a sample of a bin of a Fourier transform; the upper half is negative."""
    return F.when(index <= length / 2, _d(index) / length).otherwise((_d(index) - length) / length)


def on_diagonal(angle: Column, target: float = 135.0, tolerance: float = 10.0) -> Column:
    """Whether an angle in [0, 360) lies within the tolerance of the target or of a quarter, half or three quarters of a turn from it."""
    off = F.pmod(angle - target, F.lit(90.0))
    return (off <= tolerance) | (off >= 90.0 - tolerance)


def padding_colour(border: Column, background: Column) -> Column:
    """Colour a page is padded with, the border asked for before that of the page, and its sample value."""
    name = F.coalesce(border, background, F.lit("white"))
    return F.struct(name.alias("colour"), F.when(name == "black", 0).otherwise(255).alias("value"))


def clamp_measure(way: str, w: Column, h: Column) -> Column:
    """What a way of clamping limits: pixels in all, or the width."""
    return w.cast("long") if way == "max-width" else w.cast("long") * h.cast("long")


def clamp_limit(way: str, limit: int) -> int:
    """The limit, if the way of clamping can make progress with it."""
    if way not in CLAMP_FLOOR:
        raise ValueError(f"no way of clamping: {way}")
    if limit <= CLAMP_FLOOR[way]:
        raise ValueError(f"For {CLAMP_LABEL[way]} approach, size_threshold must be > {CLAMP_FLOOR[way]:,} pixels")
    return limit
