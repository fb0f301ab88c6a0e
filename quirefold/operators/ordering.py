"""Numbers, running sums and neighbours in ordered groups of any size.

A plain window puts each group into one task.  Here rows are dealt out by ranges of (keys, order), so
a group that holds a third of all rows lies in many parts; windows run inside the parts, and what the
parts before hold of the same group is added from a table with at most one row per part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import cut_lineage


class Ordered:
    """A frame dealt out by ranges of (keys, order); nulls in keys are values of their own.

    The order must be total for a defined result.  The frame is materialised once, so all that is
    computed of it sees the same parts.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
        self.df = cut_lineage(ranged)
        self.by = Window.partitionBy("_part", *keys).orderBy(*order)

    def _carried(self, per_part: DataFrame, carried: dict[str, Column]) -> DataFrame:
        """Each row with what the parts before hold of its group; only a part's first group can go on from one before."""
        along = Window.partitionBy(*self.keys).orderBy("_part")
        table = per_part.withColumn("_later", F.row_number().over(along) > 1)
        table = table.select("_part", *self.keys, "_later", *[c.alias(name) for name, c in carried.items()]).where("_later").drop("_later")
        table = table.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], *carried)
        same = F.col("_part") == F.col("_p")
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        # At most one row per part.
        return self.df.join(F.broadcast(table), same, "left").drop("_p", *[f"_k{i}" for i in range(len(self.keys))])

    def sums(self, **values: Column) -> Ordered:
        """Adds running sums of ``values``, the row itself included."""
        per_part = self.df.groupBy("_part", *self.keys).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in values.items()])
        before = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        joined = self._carried(per_part, {f"_c_{n}": F.sum(f"_s_{n}").over(before) for n in values})
        inside = self.by.rowsBetween(Window.unboundedPreceding, 0)
        self.df = joined.select("*", *[(F.sum(c).over(inside) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n, c in values.items()]).drop(*[f"_c_{n}" for n in values])
        return self

    def number(self, name: str) -> Ordered:
        """Adds the position in the group, from 1."""
        return self.sums(**{name: F.lit(1)})

    def before(self, name: str, value: str) -> Ordered:
        """Adds the value of the row before, null for the first of a group."""
        last = F.max_by(F.struct(value), F.struct(*self.order, F.lit(1)))
        per_part = self.df.groupBy("_part", *self.keys).agg(last.alias("_last"))
        along = Window.partitionBy(*self.keys).orderBy("_part")
        joined = self._carried(per_part, {"_prior": F.lag("_last").over(along)})
        seen = F.lag(F.struct(value)).over(self.by)
        self.df = joined.withColumn(name, F.coalesce(seen, F.col("_prior"))[value]).drop("_prior")
        return self

    def highest(self, name: str, value: Column, itself: bool = False) -> Ordered:
        """Adds the greatest value of the rows before (and of the row itself); nulls don't count."""
        valued = self.df.withColumn("_v", value)
        per_part = valued.groupBy("_part", *self.keys).agg(F.max("_v").alias("_most"))
        earlier = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        self.df = valued
        joined = self._carried(per_part, {"_prior": F.max("_most").over(earlier)})
        inside = F.max("_v").over(self.by.rowsBetween(Window.unboundedPreceding, 0 if itself else -1))
        # Structs are compared too, and greatest passes nulls over only for plain types.
        self.df = joined.withColumn("_in", inside).withColumn(name, F.when(F.col("_prior").isNull() | (F.col("_in") >= F.col("_prior")), F.col("_in")).otherwise(F.col("_prior"))).drop("_prior", "_v", "_in")
        return self

    def frame(self) -> DataFrame:
        return self.df.drop("_part")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Position from 1 in each group, however large the group is."""
    return Ordered(df, keys, order).number(name).frame()


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "run") -> DataFrame:
    """Number (from 0) of the run of equal neighbours a row is in; equal values apart are different runs."""
    marked = Ordered(df.withColumn("_any", F.lit(1)), keys, order).before("_prior_value", value).before("_has", "_any")
    changes = (F.col("_has").isNull() | ~F.col(value).eqNullSafe(F.col("_prior_value"))).cast("int")
    marked.df = cut_lineage(marked.df.withColumn("_change", changes).drop("_prior_value", "_has", "_any"))
    return marked.sums(_run=F.col("_change")).frame().withColumn(name, F.col("_run") - 1).drop("_run", "_change")
