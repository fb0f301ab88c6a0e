"""Packing chapters into tomes of fixed capacity, by a hierarchy of windows.

There are several context sizes: the tome, its half, its quarter, and so on.  A chapter is routed to
the tier of the least window that holds it.  Tiers are packed from the longest to the shortest: each
tome is opened with the longest chapter left in the tier and completed from its own tier; the gap that
stays is then filled from the shorter tiers, with those one, two or three chapters that leave least
space unused.  What the longer tiers have taken as filling is gone when a shorter tier is packed.
Tomes are then dealt to step groups of about equal weight.

Chapters over the capacity are divided between pages; their pieces are routed like chapters.  A book
with very many chapters is packed in salted groups of bounded size, and a chapter with very many pages
is divided in blocks of a bounded number of pages: the short piece at the end of a block is an item
like any other and fills a gap, so no space is lost there; each salted group may leave its last tomes
underfull.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from heapq import heapify, heapreplace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.operators.folds import map_groups
from quirefold.operators.ordering import number_rows
from quirefold.session import cut_lineage

#: Chapters that one task packs together, and pages of one chapter that one task divides together.
GROUP_ITEMS, GROUP_PAGES = 20_000, 20_000
#: Context sizes: the tome and its halvings; the last tier takes all that is shorter.
TIERS = 6
#: How many of the longest fitting chapters are tried as the first of a filling of two or three.
BREADTH = 24
STEP_TOMES = 8

PACKED = "book_id string, chapter string, profile string, piece int, n_pieces int, first_page int, last_page int, weight long, tier int, tome int, step_group int, capacity long"


def tier_of(weight: int, capacity: int) -> int:
    """0 for over the capacity, 1 for over a half of it, 2 for over a quarter, ... at most ``TIERS``."""
    if weight > capacity:
        return 0
    tier = 1
    while tier < TIERS and weight * 2**tier <= capacity:
        tier += 1
    return tier


def divide(weights: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """Runs (start, stop, weight) of pages, none heavier than the capacity unless a page alone is."""
    out, start, load = [], 0, 0
    for k, w in enumerate(weights):
        if k > start and load + w > capacity:
            out.append((start, k, load))
            start, load = k, 0
        load += w
    if weights:
        out.append((start, len(weights), load))
    return out


class Shelf:
    """Chapters of one tier that are not packed yet, by weight."""

    def __init__(self, items: list[tuple[int, object]]):
        self.items = sorted(items)

    def fitting(self, room: int) -> int:
        """How many chapters are no heavier than the room."""
        return bisect_right(self.items, room, key=lambda item: item[0])

    def take(self, at: int) -> tuple[int, object]:
        return self.items.pop(at)


def best_filling(shelf: Shelf, room: int) -> list[int]:
    """Places of the one, two or three chapters of a shelf that fill a gap best, the fewest on a tie.

    A first chapter is tried from each of the ``BREADTH`` longest that fit, its partners are looked up.
    """
    items, stop = shelf.items, shelf.fitting(room)
    if not stop:
        return []
    if not items[stop - 1][0]:
        return list(range(stop - 1, -1, -1))  # they weigh nothing
    best, least = [stop - 1], room - items[stop - 1][0]
    for i in range(stop - 1, max(-1, stop - 1 - BREADTH), -1):
        if not least:
            break
        rest = room - items[i][0]
        j = min(bisect_right(items, rest, key=lambda item: item[0]), i) - 1
        if j < 0:
            continue
        if rest - items[j][0] < least:
            best, least = [i, j], rest - items[j][0]
        for j in range(j, max(-1, j - 4), -1):
            left = rest - items[j][0]
            k = min(bisect_right(items, left, key=lambda item: item[0]), j) - 1
            if k >= 0 and left - items[k][0] < least:
                best, least = [i, j, k], left - items[k][0]
    return sorted(best, reverse=True)


def _packed(items: list[tuple[int, object]], capacity: int, longest: bool) -> list[list[object]]:
    """Each tier packed by itself and its gaps filled from the shorter ones.

    Of the tiers that can fill a gap, the longest is taken, or else the one that leaves least of it.
    """
    tomes: list[list[object]] = [[item] for weight, item in sorted(items, key=lambda x: (-x[0], str(x[1]))) if weight > capacity]
    shelves = [Shelf([(w, str(x)) for w, x in items if tier_of(w, capacity) == t]) for t in range(1, TIERS + 1)]
    for t, own in enumerate(shelves):
        while own.items:
            weight, first = own.take(len(own.items) - 1)
            tome, room = [first], capacity - weight
            while True:
                fillings = []
                for k, shelf in enumerate(shelves[t:]):
                    if places := best_filling(shelf, room):
                        fillings.append((room - sum(shelf.items[at][0] for at in places), k, places))
                        if longest:
                            break
                if not fillings:
                    break
                room, k, places = min(fillings)
                tome += [shelves[t + k].take(at)[1] for at in places]
            tomes.append(tome)
    return tomes


def pack(items: list[tuple[int, object]], capacity: int) -> list[list[object]]:
    """Tomes of (weight, item); items heavier than the capacity stand alone.

    Gaps are filled in both orders of the tiers, and the packing with fewer tomes is taken.
    """
    one = _packed(items, capacity, longest=True)
    if len(one) <= max(1, -(-sum(w for w, _ in items) // capacity)):
        return one
    return min(one, _packed(items, capacity, longest=False), key=len)


def deal(loads: list[int], size: int = STEP_TOMES) -> list[int]:
    """Step group of each tome: the heaviest goes to the lightest group that still has a seat."""
    groups = max(1, -(-len(loads) // size))
    out, open_ = [0] * len(loads), [(0, g, 0) for g in range(groups)]
    heapify(open_)
    for tome in sorted(range(len(loads)), key=lambda t: (-loads[t], t)):
        load, group, seats = open_[0]
        out[tome] = group
        if seats + 1 < size:
            heapreplace(open_, (load + loads[tome], group, seats + 1))
        else:
            heapreplace(open_, (float("inf"), group, seats + 1))
    return out


def pack_chapters(encoded_pages: DataFrame, profiles: DataFrame, group_items: int = GROUP_ITEMS, group_pages: int = GROUP_PAGES) -> DataFrame:
    """Tomes of each book: book_id, chapter, profile, piece, n_pieces, first_page, last_page, weight, tier, tome, step_group, capacity.

    Each enc_id counts once (copies are equal but for the stamp; a null enc_id is one id); an unknown
    n_bytes counts as 0 and a negative one too.  A chapter has the least profile code of its pages.
    Chapters whose profile is unknown or has no positive tome_bytes can't be packed and give no rows.
    Null book_id and chapter are values of their own.  A chapter is divided, between pages in the
    order (page_ord, sub_ord, enc_id), only if it alone weighs more than a tome; a page that alone
    weighs more is a piece of its own (its tome is overfull).  tier 0 marks divided chapters.
    first_page and last_page are page_ord of a piece.  tome counts from 1 within the book, without
    gaps; tomes of a step group are of one book.
    """
    latest = F.max_by(F.struct("book_id", "chapter", "profile", "page_ord", "sub_ord", "n_bytes"), F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0)))).alias("row")
    pages = encoded_pages.groupBy("enc_id").agg(latest).select("enc_id", "row.*")
    pages = pages.withColumn("n_bytes", F.greatest(F.coalesce("n_bytes", F.lit(0)), F.lit(0)))
    chapters = pages.groupBy("book_id", "chapter").agg(
        F.sum("n_bytes").alias("weight"), F.min("profile").alias("profile"), F.min("page_ord").alias("first_page"), F.max("page_ord").alias("last_page"), F.count(F.lit(1)).alias("n_pages")
    )
    room = profiles.where("tome_bytes > 0").groupBy(F.col("code").alias("profile")).agg(F.max("tome_bytes").alias("capacity"))
    sized = chapters.join(room, "profile")
    whole = sized.where("weight <= capacity").select("book_id", "chapter", "profile", F.lit(1).alias("piece"), F.lit(1).alias("n_pieces"), "first_page", "last_page", "weight", F.lit(False).alias("divided"), "capacity")

    large = sized.where("weight > capacity").select(F.col("book_id").alias("b"), F.col("chapter").alias("c"), F.col("profile").alias("whole_profile"), "capacity")
    same = F.col("book_id").eqNullSafe(F.col("b")) & F.col("chapter").eqNullSafe(F.col("c"))
    loose = pages.join(large, same).select("book_id", "chapter", "whole_profile", "capacity", "page_ord", "sub_ord", "enc_id", "n_bytes")
    numbered = number_rows(loose, ["book_id", "chapter"], ["page_ord", "sub_ord", "enc_id"], "at")
    blocks = numbered.withColumn("block", F.floor((F.col("at") - 1) / group_pages)).drop("at")

    def cut(rows: list[tuple]) -> list[tuple]:
        book, chapter, profile, capacity, part = rows[0][0], rows[0][1], rows[0][2], rows[0][3], rows[0][8]
        runs = divide([row[7] for row in rows], capacity)
        return [(book, chapter, profile, part, k, rows[a][4], rows[b - 1][4], load, capacity) for k, (a, b, load) in enumerate(runs)]

    runs = map_groups(blocks, ["book_id", "chapter", "block"], ["page_ord", "sub_ord", "enc_id"], cut, "book_id string, chapter string, profile string, block long, at int, first_page int, last_page int, weight long, capacity long")
    by = Window.partitionBy("book_id", "chapter")
    divided = runs.select(
        "book_id", "chapter", "profile", F.row_number().over(by.orderBy("block", "at")).alias("piece"), F.count(F.lit(1)).over(by).cast("int").alias("n_pieces"), "first_page", "last_page", "weight", F.lit(True).alias("divided"), "capacity"
    )

    items = whole.unionByName(divided)
    per_book = items.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_items"))
    salted = items.join(per_book.withColumnRenamed("book_id", "counted"), F.col("book_id").eqNullSafe(F.col("counted"))).drop("counted")
    salt = F.pmod(F.xxhash64("chapter", "piece"), F.ceil(F.col("n_items") / group_items)).cast("int")

    weigh, split, room = (items.columns.index(c) for c in ("weight", "divided", "capacity"))

    def fill(rows: list[tuple]) -> list[tuple]:
        # A book has one profile; where it has several, tomes of each are kept apart.
        out, base = [], 0
        for capacity in sorted({row[room] for row in rows}):
            part = [row for row in rows if row[room] == capacity]
            tomes = pack([(row[weigh], f"{k:012d}") for k, row in enumerate(part)], capacity)
            groups = deal([sum(part[int(k)][weigh] for k in tome) for tome in tomes])
            for t, tome in enumerate(tomes):
                for row in (part[int(k)] for k in tome):
                    tier = 0 if row[split] else tier_of(row[weigh], capacity)
                    out.append((*row[:7], row[weigh], tier, base + t + 1, groups[t] + 1, capacity, row[10]))
            base += len(tomes)
        return out

    placed = salted.select(*items.columns, salt.alias("salt"))
    packed = cut_lineage(map_groups(placed, ["book_id", "salt"], ["weight", "chapter", "piece"], fill, f"{PACKED}, salt int"))
    # Tomes and step groups of a book's later salted groups count on from those of the earlier ones.
    last = packed.groupBy("book_id", "salt").agg(F.max("tome").alias("tomes"), F.max("step_group").alias("groups"))
    earlier = Window.partitionBy("book_id").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = last.select(F.col("book_id").alias("b"), F.col("salt").alias("s"), F.sum("tomes").over(earlier).alias("tomes"), F.sum("groups").over(earlier).alias("groups")).where("tomes > 0")
    joined = packed.join(base, F.col("book_id").eqNullSafe(F.col("b")) & (F.col("salt") == F.col("s")), "left")
    moved = joined.withColumn("tome", (F.col("tome") + F.coalesce("tomes", F.lit(0))).cast("int")).withColumn("step_group", (F.col("step_group") + F.coalesce("groups", F.lit(0))).cast("int"))
    return moved.select(*[c.split()[0] for c in PACKED.split(", ")])


def unused_space(tomes: DataFrame) -> DataFrame:
    """How full the tomes of each book are: book_id, capacity, n_tomes, fewest (no packing has less), weight, unused (share of the tomes' room).

    fewest is the greater of the total weight in tomes and the number of items over half a tome; an
    overfull tome (one page) counts by its weight.
    """
    each = tomes.groupBy("book_id", "capacity", "tome").agg(F.sum("weight").alias("load"), F.count_if(2 * F.col("weight") > F.col("capacity")).alias("long"))
    by = each.groupBy("book_id", "capacity").agg(F.count(F.lit(1)).alias("n_tomes"), F.sum("load").alias("weight"), F.sum("long").alias("long"), F.sum(F.greatest("load", "capacity")).alias("room"), F.sum(F.least("load", "capacity")).alias("held"))
    fewest = F.greatest(F.ceil(F.col("held") / F.col("capacity")), F.col("long"), F.lit(1)).cast("long")
    return by.select("book_id", "capacity", "n_tomes", fewest.alias("fewest"), "weight", (1 - F.col("weight") / F.col("room")).alias("unused"))
