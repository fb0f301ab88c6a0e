"""Queries of the packed-value operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.operators.packed_values import explode_packed
from quirefold.session import table

CREDIT_FIELDS = ("writers", "pencillers", "inkers", "colorists")


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of every credit field, single ones included."""
    return explode_packed(table(spark, sf_dir, "comicinfo"), ["info_id"], CREDIT_FIELDS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the fields that hold two or more."""
    return p6_values(spark, sf_dir).where("n_vals >= 2").select("info_id", "field_name", "pos", "val")


QUERIES = {"p6_found": p6_found, "p6_values": p6_values}
ORACLE: dict[str, str] = {}
