"""Joins that Spark has no operator for: the latest row before a moment, and overlapping intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.operators.ordering import Ordered


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time.

    Both sides are merged into one order, in which the last right row is the greatest so far, so nothing is paired and
    a frequent key lies in many parts; rows without an earlier right row get nulls.  On equal right times
    the greatest values count.  Null keys never match and null times come before all others.
    """
    kept = [c for c in left.columns if c not in keys]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    a = left.select(*keys, F.struct(*kept).alias("row"), F.col(left_time).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType).alias("seen"))
    b = right.where(F.col(right_time).isNotNull() & known).select(*keys, F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(right_time).alias("at"), F.lit(0).alias("side"), F.struct(*value).alias("seen"))
    merged = Ordered(a.unionByName(b), keys, ["at", "side", "seen"])
    latest = merged.highest("last", F.when(F.col("side") == 0, F.struct("at", "seen")), itself=True).frame().where("side = 1")
    return latest.select(*keys, "row.*", *[F.when(known & F.col("at").isNotNull(), F.col(f"last.seen.{v}")).alias(v) for v in value])


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int, left_span: tuple[str, str] = ("start", "stop"), right_span: tuple[str, str] = ("start2", "stop2")) -> DataFrame:
    """Pairs of equal keys whose half-open spans overlap.

    Spans are cut into buckets of ``width`` and joined on (keys, bucket); a pair is kept in the first
    bucket both reach, so no pair comes twice and hot keys are spread over their buckets.
    """
    (a, b), (c, d) = left_span, right_span
    x = left.where(F.col(a) < F.col(b)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))))
    y = right.where(F.col(c) < F.col(d)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(c) / width), F.floor((F.col(d) - 1) / width))))
    met = x.join(y, [*keys, "bucket"]).where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))
    return met.where(F.col("bucket") == F.floor(F.greatest(F.col(a), F.col(c)) / width)).drop("bucket")
