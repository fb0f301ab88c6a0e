"""Ordered folds: state carried from row to row of a group, in order.

No SQL window expresses these (each row's state depends on the decision taken at the row before).
Rows are hashed by group, sorted inside their partitions and streamed through Arrow batches, so a
fold holds one batch and one state, however large its group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an output batch.
BATCH = 10_000


def _schema(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def _batches(rows: Iterable[tuple], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*held), arrow)], schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def fold_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], list], step: Callable[[list, tuple], tuple], schema: str) -> DataFrame:
    """One output row per row: ``step(state, row)`` returns it and changes ``state``, which ``start()`` makes anew for each group.

    ``row`` has the columns of ``df`` in their order.  Nulls in keys are values of their own.  The
    order must be total for a defined result; nulls come first.
    """
    names = df.columns
    at = [names.index(k) for k in keys]
    arrow = to_arrow_schema(_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, state = object(), []
            for row in _rows(batches):
                now = tuple(row[i] for i in at)
                if now != key:
                    key, state = now, start()
                yield step(state, row)

        yield from _batches(rows(), arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], function: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``function`` of the rows of each group, which are held in memory together: the caller bounds the groups.

    Unlike a grouped map it crosses to Python once per batch, not once per group.
    """
    names = df.columns
    at = [names.index(k) for k in keys]
    arrow = to_arrow_schema(_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, held = None, []
            for row in _rows(batches):
                now = tuple(row[i] for i in at)
                if held and now != key:
                    yield from function(held)
                    held = []
                key = now
                held.append(row)
            if held:
                yield from function(held)

        yield from _batches(rows(), arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def greedy_pack(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, capacity: int) -> DataFrame:
    """Shard number (from 0) of each row: a new shard starts if the present one holds something and the row doesn't fit.

    A row larger than the capacity stands alone.  A null size counts as 0.  Adds the column ``shard``.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    at = df.columns.index(size)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def step(state: list, row: tuple) -> tuple:
        weight = row[at] or 0
        if state[2] and state[1] + weight > capacity:
            state[0], state[1], state[2] = state[0] + 1, 0, 0
        state[1] += weight
        state[2] += 1
        return (*row, state[0])

    return fold_rows(df, keys, order, lambda: [0, 0, 0], step, f"{kept}, shard long")


def pack_units(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, half: str, capacity: int) -> DataFrame:
    """As ``greedy_pack``, but a row whose ``half`` is 'above' and a following 'below' are one unit.

    Adds ``unit`` (from 0) and ``shard``.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    # In a run of halves an above takes the below after it; a below is taken only by an above.
    joined = F.when((F.col(half) == "below") & (F.lag(half).over(by) == "above"), 0).otherwise(1)
    numbered = df.withColumn("unit", F.sum(joined).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    sizes = numbered.groupBy(*keys, "unit").agg(F.sum(F.coalesce(size, F.lit(0))).cast("long").alias("unit_size"))
    packed = greedy_pack(sizes, keys, ["unit"], "unit_size", capacity)
    right = packed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("unit").alias("_unit"), "shard")
    same = F.col("unit") == F.col("_unit")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return numbered.join(right, same).drop("_unit", *[f"_{k}" for k in keys])


def pack_heights(df: DataFrame, keys: Sequence[str], order: Sequence[str], height: str, page: int) -> DataFrame:
    """Virtual page (from 0) of each strip part: it goes on while the part leaves room over (strictly)."""
    at = df.columns.index(height)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def step(state: list, row: tuple) -> tuple:
        tall = row[at] or 0
        if state[1] - tall > 0:
            state[1] -= tall
        else:
            state[0] += state[2] > 0
            state[1] = page - tall
        state[2] += 1
        return (*row, state[0])

    return fold_rows(df, keys, order, lambda: [0, page, 0], step, f"{kept}, virtual_page long")


def gap_groups(df: DataFrame, keys: Sequence[str], value: str, gap: float) -> DataFrame:
    """Groups (first_value, last_value) of sorted values no further than ``gap`` apart.

    The value that ends a group is dropped and the next one opens the following group, as the
    margin detection this stems from does: 1, 2, 3, 10, 11 within 2 gives (1, 3) and (11, 11).
    Null values are ignored.
    """
    names = [*keys, value]
    plain = df.select(*names).where(F.col(value).isNotNull())
    types = {f.name: f.dataType.simpleString() for f in plain.schema}
    arrow_schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", first_value {types[value]}, last_value {types[value]}"
    arrow = to_arrow_schema(_schema(arrow_schema))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key, first, last = None, None, None
            for row in _rows(batches):
                now, v = row[:n], row[n]
                if now != key:
                    if first is not None:
                        yield (*key, first, last)
                    key, first = now, None
                if first is None:
                    first = last = v
                elif v - last <= gap:
                    last = v
                else:
                    yield (*key, first, last)
                    first = None
            if first is not None:
                yield (*key, first, last)

        yield from _batches(rows(), arrow)

    return plain.repartition(*keys).sortWithinPartitions(*names).mapInArrow(run, arrow_schema)


def bookmark_targets(bookmarks: Column, classes: Column, delta: int) -> Column:
    """Bookmarks (image, title) moved past the pages that were split before them.

    ``classes`` are the order classes of the output pages in order.  A bookmark looks at the pages up
    to its image plus the shift of the bookmark before it, and moves by ``delta`` for each first half
    ('b') among them.  Bookmarks outside the book are dropped, null images too.
    """
    pages = F.size(classes)

    def follow(state: Column, mark: Column) -> Column:
        reach = mark["image"] + state["shift"]
        seen = F.slice(classes, F.lit(1), F.greatest(F.least(reach + 1, pages), F.lit(0)))
        shift = F.size(F.filter(seen, lambda c: c == "b")) * F.lit(delta)
        target = mark["image"] + shift
        kept = (reach < pages) & (target < pages) & (mark["image"] >= 0)
        item = F.struct(target.cast("int").alias("image"), mark["title"].alias("title"))
        out = F.when(kept, F.concat(state["out"], F.array(item))).otherwise(state["out"])
        return F.struct(F.coalesce(shift, F.lit(0)).cast("int").alias("shift"), out.alias("out"))

    empty = F.array().cast("array<struct<image:int,title:string>>")
    return F.aggregate(bookmarks, F.struct(F.lit(0).cast("int").alias("shift"), empty.alias("out")), follow, lambda state: state["out"])
