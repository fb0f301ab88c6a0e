"""Sizes, crop boxes and splits of pages as Spark expressions over their dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ratios at which spreads are split or turned, and heights of pages and strips.
SPLIT_RATIO, BISECT_RATIO, TALL = 1.16, 1.8, 1920
KEEP_RATIO, HALVES_RATIO = 1.5, 2.0
#: Bands of a cover's ratio: above which ratio, and left and right edge of the crop read right to left.
COVER_BANDS = ((2.0, 1 / 6, 0.5 - 0.02), (1.83, 0.19, 0.575), (1.7, 0.2, 0.583), (1.34, 0.0, 0.5 - 0.03), (1.0, 0.36, 1.0))


def _d(c: Column) -> Column:
    return c.cast("double")


def _n(c: Column) -> Column:
    """A divisor: null instead of 0, so that a page without extent has null sizes and fails no job."""
    return F.nullif(_d(c), F.lit(0.0))


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))


def contain_size(w: Column, h: Column, W: Column, H: Column) -> Column:
    """Largest size of the same shape inside W x H, rounded half away from zero, at least 1."""
    tall = F.greatest(F.round(_d(h) / _n(w) * _d(W)), F.lit(1.0))
    wide = F.greatest(F.round(_d(w) / _n(h) * _d(H)), F.lit(1.0))
    image, frame = _d(w) / _n(h), _d(W) / _n(H)
    return F.when(image > frame, _size(W, tall)).when(image < frame, _size(wide, H)).otherwise(_size(W, H))


def thumbnail_size(w: Column, h: Column, W: Column, H: Column) -> Column:
    """As ``contain_size``, but never larger than the image."""
    return F.when((w <= W) & (h <= H), _size(w, h)).otherwise(contain_size(w, h, W, H))


def fit_box(w: Column, h: Column, W: Column, H: Column) -> Column:
    """Middle crop (left, top, width, height) that has the shape of W x H."""
    image, frame = _d(w) / _n(h), _d(W) / _n(H)
    high = F.greatest(F.round(_d(w) / frame), F.lit(1.0)).cast("long")
    wide = F.greatest(F.round(_d(h) * frame), F.lit(1.0)).cast("long")

    def box(left: Column, top: Column, width: Column, height: Column) -> Column:
        return F.struct(left.cast("long").alias("left"), top.cast("long").alias("top"), width.cast("long").alias("width"), height.cast("long").alias("height"))

    zero = F.lit(0)
    narrow = box(zero, F.floor(F.greatest(h - F.round(_d(w) / frame), F.lit(0.0)) / 2), w, high)
    broad = box(F.floor(F.greatest(w - F.round(_d(h) * frame), F.lit(0.0)) / 2), zero, wide, h)
    return F.when(F.abs(frame - image) < 2.220446049250313e-16, box(zero, zero, w, h)).when(frame > image, narrow).otherwise(broad)


def pad_offset(w: Column, W: Column) -> Column:
    """Margin before a part of size w that is centred in W."""
    return F.floor(F.greatest(W - w, F.lit(0)) / 2).cast("long")


def limit_pixels(w: Column, h: Column, limit: int) -> Column:
    """Size of the same shape with at most about ``limit`` pixels; unchanged if it has no more."""
    scale = F.sqrt(F.lit(float(limit)) / _n(w.cast("long") * h.cast("long")))
    small = _size(F.greatest(F.round(_d(w) * scale), F.lit(1.0)), F.greatest(F.round(_d(h) * scale), F.lit(1.0)))
    return F.when(w.cast("long") * h.cast("long") <= limit, _size(w, h)).otherwise(small)


def limit_width(w: Column, h: Column, limit: int) -> Column:
    """Size of the same shape at most ``limit`` wide."""
    return F.when(w <= limit, _size(w, h)).otherwise(_size(F.lit(limit), F.greatest(F.round(_d(h) * (F.lit(float(limit)) / _n(w))), F.lit(1.0))))


def resize_plan(w: Column, h: Column, W: Column, H: Column, near: float = 0.015, stretch: bool = False, upscale: bool = False, pads: bool = False) -> Column:
    """What is done to a page for a frame, and its size then: stretch, keep, fit, pad or contain."""

    def plan(name: str, size: Column) -> Column:
        return F.struct(F.lit(name).alias("op"), size["width"].alias("width"), size["height"].alias("height"))

    whole = _size(W, H)
    if stretch:
        return plan("stretch", whole)
    alike = F.abs(_d(h) / _n(w) - _d(H) / _n(W)) < near
    rest = plan("pad", whole) if pads else plan("contain", contain_size(w, h, W, H))
    out = F.when(alike, plan("fit", whole)).otherwise(rest)
    return out if upscale else F.when((w <= W) & (h <= H), plan("keep", _size(w, h))).otherwise(out)


def cover_box(w: Column, h: Column, right_to_left: bool = True) -> Column:
    """Left and right edge of the front of a wrap-around cover, rounded half to even; null if it has none."""
    ratio = _d(w) / _n(h)
    out = F.lit(None).cast("struct<left:bigint,right:bigint>")
    for above, left, right in reversed(COVER_BANDS):
        a, b = (left, right) if right_to_left else (1 - right, 1 - left)
        box = F.struct(F.rint(_d(w) * a).cast("long").alias("left"), F.rint(_d(w) * b).cast("long").alias("right"))
        out = F.when(ratio > above, box).otherwise(out)
    return out


def spread_parts(w: Column, h: Column, W: Column, H: Column, splitter: str = "split", right_to_left: bool = False) -> Column:
    """Parts (order_class, width, height) of a page: whole x, first half b, second half c, turned d or a.

    A page that lies across the frame and is wider than 1.16 to 1 is halved below 1.8 to 1 and turned
    beyond; ``rotate`` always turns, ``both`` does both.  An odd width loses its middle column.
    """

    def part(name: str, width: Column, height: Column) -> Column:
        return F.struct(F.lit(name).alias("order_class"), width.cast("long").alias("width"), height.cast("long").alias("height"))

    half = F.floor(w / 2)
    halves = [part("b", half, h), part("c", half, h)]
    turned = part("a" if right_to_left else "d", h, w)
    ratio, across = _d(w) / _n(h), (w > h) != (W > H)
    wide = across & (ratio > SPLIT_RATIO)
    whole = F.array(part("x", w, h))
    if splitter == "split":
        return F.when(wide & (ratio < BISECT_RATIO), F.array(*halves)).when(wide, F.array(turned)).otherwise(whole)
    if splitter == "rotate":
        return F.when(wide | (across & (w <= H) & (h <= W)), F.array(turned)).otherwise(whole)
    if splitter == "both":
        return F.when(wide & (ratio < BISECT_RATIO), F.array(*halves, turned)).when(wide, F.array(turned)).otherwise(whole)
    raise ValueError("splitter is split, rotate or both")


def tall_parts(h: Column, limit: int = TALL) -> Column:
    """Parts (half, top, height) of a page cut once at ``limit``."""

    def part(name: str, top: Column, height: Column) -> Column:
        return F.struct(F.lit(name).alias("half"), top.cast("long").alias("top"), height.cast("long").alias("height"))

    return F.when(h > limit, F.array(part("above", F.lit(0), F.lit(limit)), part("below", F.lit(limit), h - limit))).otherwise(F.array(part("none", F.lit(0), h)))


def restack_size(w: Column, h: Column) -> Column:
    """Size of a strip whose halves are put under each other."""
    return _size(F.floor(w / 2), h * 2)


def overlap_parts(top: Column, bottom: Column, view: int) -> Column:
    """Overlapping views (top, bottom) of a panel: itself up to 1.5 views, two up to 2, else as many as it takes."""
    h = bottom - top

    def part(a: Column, b: Column) -> Column:
        return F.struct(a.cast("long").alias("top"), b.cast("long").alias("bottom"))

    n = F.ceil(_d(h) / view).cast("long")
    step = F.floor(h / n)
    middle = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n - 2, F.lit(1))), lambda k: part(top + k * step, top + k * step + view))
    many = F.concat(F.array(part(top, top + view)), F.when(n > 2, middle).otherwise(F.array().cast("array<struct<top:bigint,bottom:bigint>>")), F.array(part(bottom - view, bottom)))
    two = F.array(part(top, bottom - (h - view)), part(bottom - view, bottom))
    return F.when(_d(h) <= view * KEEP_RATIO, F.array(part(top, bottom))).when(_d(h) <= view * HALVES_RATIO, two).otherwise(many)


def halved_parts(w: Column, h: Column, limit: int) -> Column:
    """Parts (top, height) of an image halved crosswise until each has fewer than ``limit`` pixels or one row.

    The upper half of an odd height is the smaller one.  The number of halvings follows from the height.
    """
    first = F.array(F.struct(F.lit(0).cast("long").alias("top"), h.cast("long").alias("height")))

    def halve(parts: Column, _: Column) -> Column:
        def cut(p: Column) -> Column:
            upper = F.floor(p["height"] / 2)
            pair = F.array(F.struct(p["top"].alias("top"), upper.alias("height")), F.struct((p["top"] + upper).alias("top"), (p["height"] - upper).alias("height")))
            return F.when((w.cast("long") * p["height"] < limit) | (p["height"] <= 1), F.array(p)).otherwise(pair)

        return F.flatten(F.transform(parts, cut))

    needed = F.ceil(F.log2(F.greatest(h.cast("double"), F.lit(1.0)))).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), F.greatest(needed, F.lit(1))), first, halve)


def clamp_box(left: Column, top: Column, right: Column, bottom: Column, w: Column, h: Column, share: float = 0.1) -> Column:
    """A crop box that takes at most ``share`` from each side, its edges rounded half to even."""
    edges = {
        "left": F.least(_d(left), _d(w) * share),
        "top": F.least(_d(top), _d(h) * share),
        "right": F.greatest(_d(right), _d(w) * (1 - share)),
        "bottom": F.greatest(_d(bottom), _d(h) * (1 - share)),
    }
    return F.struct(*[F.rint(edge).cast("long").alias(name) for name, edge in edges.items()])


def kept_span(start: Column, end: Column, keep: float = 0.04) -> Column:
    """What is removed of an empty span when a share of it is kept as margin (truncated)."""
    margin = _d(end - start) * (keep / 2)
    return F.struct((_d(start) + margin).cast("long").alias("first"), (_d(end) - margin).cast("long").alias("last"))


def view_height(strip: Column, W: Column, H: Column, widest: int = 1072) -> Column:
    """Rows of a strip that fill a frame, with the strip's width at most ``widest`` (truncated)."""
    base = F.when(W > widest, _d(H) / widest).otherwise(_d(H) / _n(W))
    return (base * F.least(F.lit(widest), W, strip)).cast("long")


def boxes_meet(a: Column, b: Column, dx: float = 0.0, dy: float = 0.0) -> Column:
    """Whether two boxes (x1, x2, y1, y2) come within dx and dy of each other."""
    return (a["x1"] <= b["x2"] + dx) & (b["x1"] <= a["x2"] + dx) & (a["y1"] <= b["y2"] + dy) & (b["y1"] <= a["y2"] + dy)


def boxes_union(a: Column, b: Column) -> Column:
    """The box around two."""
    return F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["y2"], b["y2"]).alias("y2"))


def threshold_from_power(power: Column) -> Column:
    """Grey level below which a pixel counts as ink."""
    return F.lit(240.0) - power * 64.0


def palette_bits(colours: Column) -> Column:
    """Bits a pixel of a palette needs in a PNG."""
    return F.when(colours <= 2, 1).when(colours <= 4, 2).when(colours <= 16, 4).otherwise(8)


def spread_side(order_class: Column, position: Column, next_special: Column, last_special: Column, right_to_left: bool, opening: str) -> Column:
    """Side of a page from its class, its position and those of the nearest pages that aren't whole ones (null if none)."""
    first, second = ("right", "left") if right_to_left else ("left", "right")

    def alternate(start: str, steps: Column) -> Column:
        other = "left" if start == "right" else "right"
        return F.when(F.pmod(steps, F.lit(2)) == 0, start).otherwise(other)

    before = alternate(second, next_special - position - 1)
    after = alternate(first, position - last_special - 1)
    return (
        F.when(order_class.isin("a", "d"), "center")
        .when(order_class == "b", first)
        .when(order_class == "c", second)
        .when(next_special.isNotNull(), before)
        .when(last_special.isNotNull(), after)
        .otherwise(alternate(opening, position))
    )
