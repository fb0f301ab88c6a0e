"""Packing chapters: capacity, wholeness, little unused space."""

import math
import random
from collections import defaultdict

from quirefold.llm.tomes import Shelf, best_filling, deal, divide, pack, pack_chapters, tier_of, unused_space

ENC = "enc_id long, book_id string, profile string, chapter string, chapter_ord int, page_ord int, sub_ord int, n_bytes long, loaded_at timestamp, weight int, capacity int, salt int, b string, c string"
PROFILES = "code string, tome_bytes long"


def enc(i, book, chapter, page, size, profile="A"):
    return (i, book, profile, chapter, 1, page, 0, size, None, 1, 1, 1, "b", "c")


def test_tiers_and_division():
    assert [tier_of(w, 100) for w in (101, 100, 51, 50, 26, 25, 1, 0)] == [0, 1, 1, 2, 2, 3, 6, 6]
    assert divide([50, 60, 10, 200, 1], 100) == [(0, 1, 50), (1, 3, 70), (3, 4, 200), (4, 5, 1)]
    assert divide([], 100) == []


def test_pack_is_tight():
    rng = random.Random(1)
    for _ in range(100):
        items = [(rng.randrange(0, 100), f"{k:04d}") for k in range(rng.randrange(1, 80))]
        tomes = pack(items, 100)
        weight = {k: w for w, k in items}
        loads = [sum(weight[k] for k in t) for t in tomes]
        assert sorted(k for t in tomes for k in t) == sorted(weight) and max(loads) <= 100
        least = math.ceil(sum(weight.values()) / 100)
        assert len(tomes) <= math.ceil(11 * least / 9) + 2 or len(tomes) <= sum(w > 50 for w, _ in items) + 2


def fullest_first(weights, capacity):
    """Number of tomes of plain best fit, longest first."""
    rooms = []
    for w in sorted(weights, reverse=True):
        fits = [r for r in rooms if r >= w]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - w)
    return len(rooms)


def test_gaps_are_filled_from_shorter_tiers():
    # Best fit puts 30 beside 55 and then needs a third tome; two shorter ones fill the gap to the last.
    weights = [55, 52, 30, 25, 20, 18]
    tomes = pack([(w, f"{w}") for w in weights], 100)
    assert sorted(sorted(int(x) for x in t) for t in tomes) == [[18, 30, 52], [20, 25, 55]] and fullest_first(weights, 100) == 3
    assert best_filling(Shelf([(5, "a"), (7, "b"), (9, "c")]), 12) == [1, 0] and best_filling(Shelf([(5, "a"), (5, "b"), (5, "c")]), 15) == [2, 1, 0] and best_filling(Shelf([(5, "a")]), 4) == []
    rng = random.Random(5)
    ours = plain = 0
    for _ in range(200):
        weights = [rng.randrange(1, 70) for _ in range(rng.randrange(3, 60))]
        ours, plain = ours + len(pack([(w, f"{k:03}") for k, w in enumerate(weights)], 100)), plain + fullest_first(weights, 100)
    assert ours <= plain


def test_step_groups_are_balanced():
    rng = random.Random(2)
    loads = [rng.randrange(1, 100) for _ in range(64)]
    sums = defaultdict(int)
    for g, w in zip(deal(loads), loads):
        sums[g] += w
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 100


def test_table(spark):
    rows = [enc(1, "B", "1", 1, 60), enc(2, "B", "1", 2, 70), enc(2, "B", "1", 2, 70), enc(3, "B", "2", 1, None), enc(4, "B", None, 1, 30), enc(5, None, "1", 1, 20), enc(6, "C", "1", 1, 400), enc(7, "D", "1", 1, 5, "?"), enc(8, "B", "3", 1, 30), enc(None, "B", "4", 1, -5)]
    profiles = spark.createDataFrame([("A", 100), ("A", 100), ("Z", None)], PROFILES)
    out = pack_chapters(spark.createDataFrame(rows, ENC), profiles).collect()
    by = defaultdict(list)
    for r in out:
        by[r.book_id, r.chapter].append(r)
    assert sorted((r.piece, r.weight, r.first_page, r.last_page) for r in by["B", "1"]) == [(1, 60, 1, 1), (2, 70, 2, 2)]
    assert {r.tier for r in by["B", "1"]} == {0} and by["C", "1"][0].tier == 0 and by["C", "1"][0].weight == 400
    assert by["B", "2"][0].weight == 0 and by["B", "4"][0].weight == 0 and ("B", None) in by and (None, "1") in by and ("D", "1") not in by
    loads = defaultdict(int)
    for r in out:
        loads[r.book_id, r.tome] += r.weight
    assert all(v <= 100 for k, v in loads.items() if k[0] != "C")
    assert pack_chapters(spark.createDataFrame([], ENC), profiles).collect() == []


def test_hot_book_in_salted_groups(spark):
    rng = random.Random(3)
    rows = [enc(k, "B", f"c{k // 2}", k % 2, rng.randrange(1, 60)) for k in range(1200)]
    profiles = spark.createDataFrame([("A", 100)], PROFILES)
    out = pack_chapters(spark.createDataFrame(rows, ENC), profiles, group_items=50).collect()
    loads = defaultdict(int)
    for r in out:
        loads[r.tome] += r.weight
    assert max(loads.values()) <= 100 and sum(loads.values()) == sum(r[7] for r in rows)
    assert len(loads) <= fullest_first([r.weight for r in out], 100) + 12
    assert set(loads) == set(range(1, len(loads) + 1))
    told = unused_space(spark.createDataFrame(out)).collect()[0]
    assert told.n_tomes == len(loads) >= told.fewest and len(loads) <= 1.1 * told.fewest + 12 and 0 <= told.unused < 0.25


def test_hot_chapter_in_blocks(spark):
    rows = [enc(k, "B", "1", k, 30) for k in range(400)]
    out = pack_chapters(spark.createDataFrame(rows, ENC), spark.createDataFrame([("A", 100)], PROFILES), group_pages=40).orderBy("piece").collect()
    assert [r.piece for r in out] == list(range(1, len(out) + 1)) and {r.n_pieces for r in out} == {len(out)}
    assert out[0].first_page == 0 and out[-1].last_page == 399 and all(b.first_page == a.last_page + 1 for a, b in zip(out, out[1:]))
    assert all(r.weight <= 100 for r in out)


def test_blocks_go_by_count(spark):
    """Equal and missing page numbers don't keep a chapter together."""
    rows = [(k, "B", "A", "1", 1, None if k % 2 else 7, 0, 30, None, 1, 1, 1, "b", "c") for k in range(300)]
    out = pack_chapters(spark.createDataFrame(rows, ENC), spark.createDataFrame([("A", 100)], PROFILES), group_pages=40).collect()
    assert sum(r.weight for r in out) == 9000 and all(r.weight <= 100 for r in out) and len(out) == 7 * 14 + 7
