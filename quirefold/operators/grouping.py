"""Grouping, numbering and lookup over ordered collections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import depth, is_junk, natural_key
from quirefold.operators.ordering import Ordered, number_rows, runs


def without_repeats(df: DataFrame, *stamps: str) -> DataFrame:
    """Rows delivered twice once: distinct rows but for the arrival stamps (maps can't be compared and are left out too)."""
    kept = [f.name for f in df.schema if f.name not in stamps and f.dataType.typeName() != "map"]
    return df.select(*kept).distinct()


def single_root(entries: DataFrame, source: str, path: str, is_dir: str) -> DataFrame:
    """The one top folder of each source (source, root); null if a file lies at the root or there are several tops.

    ``path`` is a normalised path; junk and null paths don't count; a source with nothing else has null.
    """
    counts = ~F.coalesce(is_junk(F.col(path)), F.lit(True))
    top = F.when(counts, F.element_at(F.split(path, "/"), 1))
    loose = counts & ~F.coalesce(F.col(is_dir), F.lit(False)) & (depth(F.col(path)) == 1)
    by = entries.groupBy(source).agg(F.min(top).alias("least"), F.max(top).alias("most"), F.max(loose).alias("loose"))
    return by.select(source, F.when((F.col("least") == F.col("most")) & ~F.coalesce("loose", F.lit(False)), F.col("least")).alias("root"))


def most_common(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str | Column]) -> DataFrame:
    """The most frequent value of each group, the one seen first on a tie: keys, value, n.

    ``order`` are columns; the smallest struct of them is the first sight.  Nulls are no values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("seen"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("seen"), F.col(value).alias("value"))).alias("best"))
    return best.select(*keys, F.col("best.value").alias(value), (-F.col("best.less")).alias("n"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The first row of each group in an order, without sorting the groups."""
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *[k for k in kept if k not in order])).alias("first"))
    return best.select(*keys, *[F.col(f"first.{k}").alias(k) for k in kept])


def largest_of(df: DataFrame, keys: Sequence[str], size: str, order: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """The row of the greatest size of each group, the first in the order on a tie.  Null sizes come last."""
    by = F.struct((-F.coalesce(F.col(size), F.lit(-1))).alias("less"), *order, *[k for k in kept if k not in order])
    best = df.groupBy(*keys).agg(F.min(by).alias("first"))
    return best.select(*keys, *[F.col(f"first.{k}").alias(k) for k in kept])


def natural_sorted(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Whether the distinct names of each group have the same natural and plain order: keys, natural.

    Both orders agree if each name's natural key is least among the names not before it; that is seen
    from neighbours in plain order, so no group is collected.
    """
    distinct = df.where(F.col(name).isNotNull()).select(*keys, name).distinct().withColumn("natural_key", natural_key(F.col(name)))
    placed = Ordered(distinct, keys, [name]).before("prior_key", "natural_key").frame()
    wrong = F.col("prior_key") > F.col("natural_key")
    return placed.withColumn("wrong", F.coalesce(wrong, F.lit(False))).groupBy(*keys).agg((~F.max("wrong")).alias("natural"))


def uniform_depth(df: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Depth of the paths of each group and whether it is mixed: keys, level, mixed."""
    deep = depth(F.col(path))
    return df.groupBy(*keys).agg(F.min(deep).alias("level"), (F.min(deep) != F.max(deep)).alias("mixed"))


def positional_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows of equal rank within equal keys side by side; rows without a partner on the right get nulls."""
    a = number_rows(left, keys, left_order, "rank")
    b = number_rows(right, keys, right_order, "rank")
    return a.join(b, [*keys, "rank"], "left")


def fuse(sources: Sequence[DataFrame], name: str) -> DataFrame:
    """Ordered union: rows of the k-th source (from 1) get source_ord k and names behind ``fusion_000k_``."""
    if len(sources) < 2:
        raise ValueError("fusion needs two sources or more")
    marked = [s.withColumn("source_ord", F.lit(k)).withColumn(name, F.concat(F.format_string("fusion_%04d_", F.lit(k)), F.col(name))) for k, s in enumerate(sources, 1)]
    return reduce(DataFrame.unionByName, marked)


def keep_lines(df: DataFrame, remove: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Rows whose (keys, line) are not in ``remove``, renumbered from 0 in the column ``kept_line``."""
    left = df.join(remove.select(*keys, line).distinct(), [*keys, line], "left_anti")
    return number_rows(left, keys, [line], "kept_line").withColumn("kept_line", F.col("kept_line") - 1)


def folder_prefixes(path: Column) -> Column:
    """All folders above a normalised path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def collision_names(df: DataFrame, keys: Sequence[str], order: Sequence[str], slug: str, raw: str) -> DataFrame:
    """Slugs made distinct inside each group by appending ``A``, unless the raw name is the slug but for case.

    Adds ``unique_slug``.  The set of used slugs is held per group, so groups are folders.
    """
    from quirefold.operators.folds import fold_rows

    at, own = df.columns.index(slug), df.columns.index(raw)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def step(used: list, row: tuple) -> tuple:
        name = row[at] or ""
        while name in used[0] and (row[own] or "").upper() != name.upper():
            name += "A"
        used[0].add(name)
        return (*row, name)

    return fold_rows(df, keys, order, lambda: [set()], step, f"{kept}, unique_slug string")


def merged_boxes(boxes: list[tuple], dx: float, dy: float) -> list[tuple]:
    """Boxes (x1, x2, y1, y2) united while any two come within dx and dy; a union goes to the end and the scan starts over."""
    at, boxes = 0, [tuple(b) for b in boxes]
    while at + 1 < len(boxes):
        x1, x2, y1, y2 = boxes[at]
        close = [k for k, (p1, p2, q1, q2) in enumerate(boxes) if k > at and p1 - dx <= x2 and p2 + dx >= x1 and q1 - dy <= y2 and q2 + dy >= y1]
        if not close:
            at += 1
            continue
        group = [boxes[at], *(boxes[k] for k in close)]
        union = (min(b[0] for b in group), max(b[1] for b in group), min(b[2] for b in group), max(b[3] for b in group))
        boxes = [b for k, b in enumerate(boxes) if k != at and k not in close] + [union]
        at = 0
    return boxes


def merge_boxes(df: DataFrame, keys: Sequence[str], order: Sequence[str], dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """``merged_boxes`` of each group's x1, x2, y1, y2 (a page's boxes): keys, box (from 0), x1, x2, y1, y2."""
    from quirefold.operators.folds import map_groups

    n = len(keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", box int, x1 long, x2 long, y1 long, y2 long"
    plain = df.select(*keys, *["x1", "x2", "y1", "y2"], *[o for o in order if o not in keys])

    def unite(rows: list[tuple]) -> list[tuple]:
        return [(*rows[0][:n], k, *box) for k, box in enumerate(merged_boxes([r[n : n + 4] for r in rows], dx, dy))]

    return map_groups(plain, keys, order, unite, schema)


def all_within(df: DataFrame, keys: Sequence[str], measure: Column, limit: int) -> DataFrame:
    """Whether every row of a group measures less than a limit: keys, within; unknown measures don't count."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_and(measure < limit), F.lit(True)).alias("within"))


def source_quality(df: DataFrame, keys: Sequence[str], small: Column, processed: Column, share: float = 0.25) -> DataFrame:
    """Signs that a source is second best: keys, n_small, n, suboptimal (more than ``share`` of its pages are small), processed (a name says so)."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(F.count_if(small).alias("n_small"), n.alias("n"), (F.count_if(small) > n * share).alias("suboptimal"), F.max(processed).alias("processed"))


def with_defaults(found: Column, *others: Column) -> Column:
    """What a lookup gave, else the first of the others that is known."""
    return F.coalesce(found, *others)
