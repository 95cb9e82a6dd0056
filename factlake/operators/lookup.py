"""Lookups by order: the last row before each place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, marks: DataFrame, key: str, place: str, value: str, tie: str) -> DataFrame:
    """``rows`` with ``value`` of the last mark of the same key at or before their place; null if there is none.

    ``marks`` has (key, place, value, tie), where of marks at one place the greatest tie counts. Both
    tables meet in one sorted sequence a key, so no row is paired with all marks of its key.
    """
    own = rows.select(key, place, F.struct(*(F.col(c) for c in rows.columns)).alias("_row"), F.lit(None).alias("_tie"), F.lit(None).alias("_mark"), F.lit(1).alias("_side"))
    other = marks.select(key, place, F.lit(None).alias("_row"), F.col(tie).alias("_tie"), F.struct(value).alias("_mark"), F.lit(0).alias("_side"))
    upto = Window.partitionBy(key).orderBy(place, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(other).withColumn("_last", F.last("_mark", ignorenulls=True).over(upto)).filter("_side = 1")
    return both.select(*(F.col(f"_row.`{c}`").alias(c) for c in rows.columns), F.col(f"_last.`{value}`").alias(value))
