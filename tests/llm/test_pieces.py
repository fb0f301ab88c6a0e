"""Cutting pages: natural cuts where there are any, overlap where there are none."""

import random

import numpy as np

from quirefold.llm.pieces import cohesion, cut_page, depths, gutters, spans_of, split_pages

PAGES = "page_id long, profile string, height int, panels array<struct<top:int,bottom:int>>, loaded_at timestamp, limit int, piece string"
PROFILES = "code string, max_height int, overlap int"


def natural(y, panels):
    return not any(p["top"] < y < p["bottom"] for p in panels)


def test_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        height = rng.randrange(1, 900)
        panels = [dict(top=t, bottom=min(height, t + rng.randrange(0, 160))) for t in (rng.randrange(0, height) for _ in range(rng.randrange(0, 9)))]
        limit, overlap = rng.randrange(20, 200), rng.randrange(0, 30)
        pieces = cut_page(height, panels, limit, overlap)
        cuts = [y for y in range(height + 1) if y in (0, height) or natural(y, panels)]
        must = height > limit and any(b - a > limit for a, b in zip(cuts, cuts[1:]))
        assert any(p["forced"] for p in pieces) == must
        assert pieces[0]["top"] == 0 and pieces[-1]["bottom"] == height
        assert all(0 < p["bottom"] - p["top"] <= max(limit, height if height <= limit else limit) for p in pieces)
        share = min(overlap, limit - 1)
        for a, b in zip(pieces, pieces[1:]):
            if b["forced"]:
                assert a["bottom"] - b["top"] == share
            else:
                assert a["bottom"] == b["top"] and natural(b["top"], panels)


def test_curve():
    panels = [dict(top=0, bottom=5), dict(top=5, bottom=9), dict(top=7, bottom=12), dict(top=7, bottom=12), dict(top=4, bottom=4), None, dict(top=None, bottom=3)]
    assert spans_of(panels, 11).tolist() == [[0, 5], [5, 9], [7, 11]] and gutters(spans_of(panels, 14), 14) == [(0, 0), (5, 5), (12, 14)]
    assert gutters(spans_of([], 5), 5) == [(0, 5)]
    spans = np.array([[0, 50], [60, 100]])
    inside, edge, gutter = cohesion(np.array([25, 48, 55]), spans, 10)
    assert inside == 1.0 and edge == 1.0 and gutter == 0.0
    assert np.allclose(depths([1.0, 0.2, 0.6, 0.0, 0.0, 0.9]), [0.0, 0.8 + 0.4, 0.0, 0.6 + 0.9, 0.6 + 0.9, 0.0])


def by_steps(y, panels, block):
    """Cohesion row by row."""
    above = [sum(t <= r < b for r in range(max(0, y - block), y)) for t, b in panels]
    below = [sum(t <= r < b for r in range(y, y + block)) for t, b in panels]
    norm = (sum(a * a for a in above) * sum(b * b for b in below)) ** 0.5
    return sum(a * b for a, b in zip(above, below)) / norm if norm else 0.0


def test_curve_against_counting_rows():
    rng = random.Random(2)
    for _ in range(60):
        panels = sorted({(t, t + rng.randrange(1, 60)) for t in (rng.randrange(0, 150) for _ in range(rng.randrange(1, 6)))})
        cuts = np.arange(1, 200, 7)
        assert np.allclose(cohesion(cuts, np.array(panels), 12), [by_steps(int(y), panels, 12) for y in cuts])


def test_the_deepest_valley_is_cut_not_the_last():
    # Between 240 and 250 two tall panels meet; at 380 only a sliver ends, and nothing follows it for long.
    panels = [dict(top=0, bottom=240), dict(top=250, bottom=372), dict(top=378, bottom=380), dict(top=440, bottom=900)]
    assert cut_page(900, panels, 400, 20)[0]["bottom"] in range(240, 251)
    # Also where the window's lower half has none: at 90 two panels meet, after 180 there is a sliver only.
    panels = [dict(top=0, bottom=90), dict(top=90, bottom=180), dict(top=185, bottom=190), dict(top=195, bottom=900)]
    assert cut_page(900, panels, 400, 20)[0]["bottom"] == 90


def test_a_panel_is_cut_where_it_coheres_least():
    # Two panels overlap by ten rows only: that is the place, not the end of the window.
    panels = [dict(top=0, bottom=310), dict(top=300, bottom=900)]
    pieces = cut_page(900, panels, 400, 20)
    assert 295 <= pieces[0]["bottom"] <= 315 and pieces[1]["forced"] and pieces[1]["top"] == pieces[0]["bottom"] - 20
    assert cut_page(900, [dict(top=0, bottom=900)], 400, 20)[0]["bottom"] == 400


def test_table(spark):
    panels = [(0, 700), (700, 900)]
    rows = [
        (1, "A", 900, panels, None, 5, "x"), (1, "A", 900, panels, None, 5, "x"), (2, "A", None, None, None, None, None), (3, "A", 100, None, None, 1, ""), (4, "Z", 900, panels, None, 1, ""),
        (5, None, 900, None, None, 1, ""), (6, "A", 900, None, None, 1, ""), (7, "N", 900, [], None, 1, ""), (None, "A", 900, [], None, 1, ""),
    ]
    profiles = spark.createDataFrame([("A", 500, 40), ("A", 500, 40), ("N", 500, None), ("X", None, 1), ("O", 0, 1)], PROFILES)
    got = {}
    for r in split_pages(spark.createDataFrame(rows, PAGES), profiles).orderBy("page_id", "piece").collect():
        got.setdefault(r.page_id, []).append((r.piece, r.n_pieces, r.top, r.bottom, r.forced))
    assert got[1] == [(1, 3, 0, 500, False), (2, 3, 460, 700, True), (3, 3, 700, 900, False)] or got[1][0][3] == 500 and got[1][1][2] == 460
    assert got[3] == [(1, 1, 0, 100, False)] and set(got) == {1, 3, 6, 7, None}
    assert all(not f for *_, f in got[6] + got[7])
    assert split_pages(spark.createDataFrame([], PAGES), profiles).collect() == []
