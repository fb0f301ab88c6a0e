"""Aggregates over grids of samples in table form: one row per sample, or per bin of a histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(df: DataFrame, keys: Sequence[str], row: str, samples: str) -> DataFrame:
    """One row per sample of an array column: keys, y (the row), x (from 0), v."""
    return df.select(*keys, F.col(row).alias("y"), F.posexplode(samples).alias("x", "v"))


def histogram(df: DataFrame, keys: Sequence[str], bin_: Column) -> DataFrame:
    """Counts by bin: keys, bin, n."""
    return df.withColumn("bin", bin_).where("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def trim_histogram(counts: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """A histogram without ``share`` of its samples at either end: keys, bin, n; bins left empty are dropped.

    The low end is cut first; the high end is cut from what that left.
    """
    by = Window.partitionBy(*keys)
    up = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = by.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    low = counts.withColumn("cut", F.floor(F.sum("n").over(by) * share)).withColumn("below", F.sum("n").over(up) - F.col("n"))
    low = low.withColumn("n", F.greatest(F.lit(0), F.col("n") - F.greatest(F.lit(0), F.col("cut") - F.col("below"))))
    high = low.withColumn("above", F.sum("n").over(down) - F.col("n"))
    high = high.withColumn("n", F.greatest(F.lit(0), F.col("n") - F.greatest(F.lit(0), F.col("cut") - F.col("above"))))
    return high.where("n > 0").select(*keys, "bin", "n")


def bounding_box(samples: DataFrame, keys: Sequence[str], matches: Column) -> DataFrame:
    """Half-open box of the samples that match: keys, x1, y1, x2, y2, n; groups without a match are missing."""
    return samples.where(matches).groupBy(*keys).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count(F.lit(1)).alias("n"))


def empty_lines(samples: DataFrame, keys: Sequence[str], axis: str, matches: Column) -> DataFrame:
    """Rows (axis 'y') or columns ('x') in which no sample matches: keys, line."""
    return samples.groupBy(*keys, F.col(axis).alias("line")).agg(F.max(matches.cast("int")).alias("any")).where("any = 0").drop("any")


def border_votes(samples: DataFrame, keys: Sequence[str], black: Column, strip: int = 5) -> DataFrame:
    """Votes of all strips of rows and of columns: keys, total.

    A strip votes by its area for black or white if it is all of one, else not at all; the last strip
    is moved back to be whole, so its samples can count twice.
    """
    sized = samples.withColumn("black", black.cast("int"))
    by = Window.partitionBy(*keys)
    sized = sized.withColumn("width", F.max("x").over(by) + 1).withColumn("height", F.max("y").over(by) + 1)
    votes = []
    for axis, extent in (("y", "height"), ("x", "width")):
        last = F.floor((F.col(extent) - 1) / strip)
        regular = F.floor(F.col(axis) / strip)
        in_last = F.col(axis) >= F.greatest(F.col(extent) - strip, F.lit(0))
        strips = F.array_distinct(F.when(in_last, F.array(regular, last)).otherwise(F.array(regular)))
        # A sample of the last, moved strip also belongs to its regular one, unless that is the last.
        each = sized.withColumn("strip", F.explode(strips)).where((F.col("strip") != last) | in_last)
        counted = each.groupBy(*keys, "strip").agg(F.count(F.lit(1)).alias("area"), F.sum("black").alias("blacks"))
        votes.append(counted.select(*keys, F.when(F.col("blacks") == 0, -F.col("area")).when(F.col("blacks") == F.col("area"), F.col("area")).otherwise(F.lit(0)).alias("vote")))
    return votes[0].unionByName(votes[1]).groupBy(*keys).agg(F.sum("vote").alias("total"))


def black_point(counts: DataFrame, keys: Sequence[str], dark: int = 64) -> DataFrame:
    """First bin whose count is the greatest count of the dark bins: keys, black_point."""
    most = counts.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("bin") < dark, F.col("n"))), F.lit(0)).alias("most"))
    # Bins that don't occur have count 0.
    first = counts.join(most, list(keys)).where(F.col("n") == F.col("most")).groupBy(*keys).agg(F.min("bin").alias("bin"))
    return most.join(first, list(keys), "left").select(*keys, F.coalesce("bin", F.lit(0)).alias("black_point"))


def box_blur(samples: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Three-tap mean ``(a + b + c + 1) div 3`` along an order, ends repeated: adds ``blurred``."""
    by = Window.partitionBy(*keys).orderBy(order)
    left, right = F.coalesce(F.lag(value).over(by), F.col(value)), F.coalesce(F.lead(value).over(by), F.col(value))
    return samples.withColumn("blurred", F.floor((left + F.col(value) + right + 1) / 3).cast("long"))


def panels(bands: DataFrame, keys: Sequence[str], order: str, solid: Column, least: int = 0, start: int = 0) -> DataFrame:
    """Maximal runs of bands that aren't solid: keys, top, bottom (half-open, in band numbers).

    A run shorter than ``least`` that starts before ``start`` is dropped.  Bands are numbered by
    ``order`` without gaps.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    marked = bands.withColumn("is_solid", solid).withColumn("run", F.sum(F.col("is_solid").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = marked.where(~F.col("is_solid")).groupBy(*keys, "run").agg(F.min(order).alias("top"), (F.max(order) + 1).alias("bottom")).drop("run")
    return found.where(~((F.col("top") < start) & (F.col("bottom") - F.col("top") < least)))
