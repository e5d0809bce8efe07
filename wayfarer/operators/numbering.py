"""Numbers for rows: without gaps, and the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BUCKETS = 1024


def numbered_after(rows: DataFrame, keys: list[str], start: int, name: str) -> DataFrame:
    """``rows``, which ``keys`` tell apart, with numbers from ``start + 1`` without gaps, the same in every run."""
    bucketed = rows.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))  # a row for each bucket
    nth = F.row_number().over(Window.partitionBy("_b").orderBy(*keys))
    return bucketed.withColumn("_r", nth).join(F.broadcast(offsets), "_b").withColumn(name, F.lit(start) + F.col("_o") + F.col("_r")).drop("_b", "_r", "_o")
