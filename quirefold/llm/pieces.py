"""Cutting oversized pages at the valleys of a cohesion curve.

The rows of a page are its words and its panels are its topics.  A block of rows above a cut and one
below it slide down the page; the cohesion of a cut is the cosine of the numbers of rows that each
panel has in the two blocks.  It is 1 deep inside a panel, falls where panels end, overlap or meet, and
is 0 in a gutter.  The depth of a valley is what cohesion rises to on either side of it.

Within each size window the deepest valley that spares every panel is cut; where a window has none, a
panel has to be cut, at the deepest valley there is (the least cohesive row), and then neighbouring
pieces share the given overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "array<struct<top:int,bottom:int,forced:boolean>>"
#: A block is this part of the greatest height of a piece, and the curve is sampled this often in a block.
BLOCKS, SAMPLES = 8, 2
#: Depths closer than this are equal; the later cut is taken then, which makes fewer pieces.
CLOSE = 1e-3


def spans_of(panels, height: int) -> np.ndarray:
    """The distinct panels as rows (top, bottom), sorted and inside the page; null, empty and reversed ones are none."""
    found = {(max(0, int(p["top"])), min(height, int(p["bottom"]))) for p in panels if p is not None and p["top"] is not None and p["bottom"] is not None}
    return np.array(sorted(s for s in found if s[0] < s[1]), dtype=np.int64).reshape(-1, 2)


def gutters(spans: np.ndarray, height: int) -> list[tuple[int, int]]:
    """Closed intervals of the cuts that go through no panel, the page's own ends included."""
    out, left = [], 0
    for top, bottom in spans.tolist():
        if top >= left:
            out.append((left, top))
        left = max(left, bottom)
    return [*out, (left, height)] if left <= height else out


def cohesion(cuts: np.ndarray, spans: np.ndarray, block: int) -> np.ndarray:
    """Cosine of the rows of each panel in the blocks above and below each cut; 0 where a block has no panel."""
    y, top, bottom = cuts[:, None], spans[:, 0][None, :], spans[:, 1][None, :]
    above = np.clip(np.minimum(y, bottom) - np.maximum(y - block, top), 0, None).astype(np.float64)
    below = np.clip(np.minimum(y + block, bottom) - np.maximum(y, top), 0, None).astype(np.float64)
    norm = np.sqrt((above**2).sum(1) * (below**2).sum(1))
    return np.divide((above * below).sum(1), norm, out=np.zeros(len(cuts)), where=norm > 0)


def depths(curve: Sequence[float]) -> np.ndarray:
    """How far the curve rises on the left and on the right of each point before it falls again, together."""

    def rises(values: Sequence[float]) -> list[float]:
        out, peak, last = [], -1.0, -1.0
        for v in values:
            if last < v or peak < v:
                peak = v
            out.append(peak - v)
            last = v
        return out

    return np.array(rises(curve)) + np.array(rises(curve[::-1])[::-1])


def _deepest(places: np.ndarray, depth: np.ndarray) -> int:
    return int(places[np.flatnonzero(depth >= depth.max() - CLOSE)[-1]])


def cut_page(height: int, panels, limit: int, overlap: int) -> list[dict]:
    """Pieces (top, bottom, forced) of a page, each at most ``limit`` tall; forced if its upper edge cuts a panel.

    The size window of a piece is the lower half of what it may hold, so that pieces don't get small;
    the upper half is looked at only if the lower has no cut that spares every panel.
    """
    if height <= limit:
        return [dict(top=0, bottom=height, forced=False)]
    spans = spans_of(panels if panels is not None else [], height)
    share, block = max(0, min(overlap or 0, limit - 1)), max(1, limit // BLOCKS)
    open_ = np.array(gutters(spans, height), dtype=np.int64).reshape(-1, 2)
    # The curve bends where a block's edge meets a panel's; inside panels and along gutters it is sampled.
    edges = spans.ravel()
    bends = [edges - block, edges, edges + block, spans.sum(1) // 2]
    ends = [open_.ravel(), open_.sum(1) // 2]
    cuts = np.unique(np.concatenate([*bends, *ends, np.arange(0, height, max(1, block // SAMPLES))]))
    cuts = cuts[(cuts >= 0) & (cuts <= height)]
    depth = depths(cohesion(cuts, spans, block).tolist())
    at = np.searchsorted(open_[:, 0], cuts, side="right") - 1
    spared = (at >= 0) & (cuts <= open_[at, 1])

    def valley(low: int, high: int) -> int | None:
        """The deepest place of (low, high] that spares every panel; the window's own ends count where they lie in a gutter."""
        a, b = np.searchsorted(cuts, [low + 1, high + 1])
        free = a + np.flatnonzero(spared[a:b])
        if len(free):
            return _deepest(cuts[free], depth[free])
        k = int(np.searchsorted(open_[:, 0], high, side="right")) - 1
        last = min(high, int(open_[k, 1])) if k >= 0 else -1
        return last if last > low else None

    out, top, forced = [], 0, False
    while height - top > limit:
        cut = valley(top + limit // 2, top + limit)
        if cut is None:
            cut = valley(top, top + limit // 2)
        if cut is not None:
            out.append(dict(top=top, bottom=cut, forced=forced))
            top, forced = cut, False
            continue
        # No cut spares every panel: the least cohesive row, below the rows that are shared anyway.
        low = min(top + max(limit // 2, share), top + limit - 1)
        a, b = np.searchsorted(cuts, [low + 1, top + limit + 1])
        cut = _deepest(cuts[a:b], depth[a:b]) if b > a and depth[a:b].max() > CLOSE else top + limit
        out.append(dict(top=top, bottom=cut, forced=forced))
        top, forced = cut - share, True
    out.append(dict(top=top, bottom=height, forced=forced))
    return out


def split_pages(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per piece of every page: page_id, piece (from 1), n_pieces, top, bottom, forced.

    Pages of unknown height, or whose profile is unknown or has no max_height, give no rows.  Rows
    delivered twice count once (of differing copies the one loaded last).  A null list of panels is
    an empty one; null, empty and reversed panels are ignored.  Pieces cover the page in order; where
    a panel had to be cut (forced on the lower piece) neighbours share the profile's overlap, else
    nothing.  Panels that stand twice count once.  A max_height below 1 is an error of the profile and gives no rows.
    """
    limits = profiles.select(F.col("code").alias("profile"), F.col("max_height").alias("limit"), F.col("overlap").alias("share")).where("limit >= 1").dropDuplicates(["profile"])
    latest = F.max_by(F.struct("profile", "height", "panels"), F.struct(F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0))), F.coalesce("height", F.lit(0)))).alias("row")
    once = pages.groupBy("page_id").agg(latest).select("page_id", "row.*").where("height is not null")
    known = once.join(limits, "profile")
    whole = F.array(F.struct(F.lit(0).alias("top"), F.col("height").alias("bottom"), F.lit(False).alias("forced")))

    @F.pandas_udf(PIECES)
    def cut(height: pd.Series, panels: pd.Series, limit: pd.Series, share: pd.Series) -> pd.Series:
        return pd.Series([cut_page(int(h), p, int(m), int(s) if s == s else 0) for h, p, m, s in zip(height, panels, limit, share)])

    small = known.where("height <= limit").select("page_id", whole.alias("pieces"))
    tall = known.where("height > limit").select("page_id", cut("height", "panels", "limit", "share").alias("pieces"))
    rows = small.unionByName(tall).select("page_id", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece", "p"))
    return rows.select("page_id", (F.col("piece") + 1).alias("piece"), "n_pieces", "p.top", "p.bottom", "p.forced")
