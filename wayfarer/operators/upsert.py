"""Upserts as new snapshots: a full outer join of what is stored and what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], greatest: tuple[str, ...] = ()) -> DataFrame:
    """The next snapshot: new values where there are any, stored ones else; columns in ``greatest`` never fall.

    ``new`` may repeat a key: of its rows the one of the largest values counts. Rows get ``change``: insert, update or
    keep.
    """
    values = [c for c in stored.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in values])).alias("n"))
    old = stored.select(*keys, F.struct(*values).alias("o"))
    joined = old.join(once, keys, "full_outer")
    pick = lambda c: F.greatest(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in greatest else F.coalesce(f"n.{c}", f"o.{c}")
    change = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "keep").otherwise("update")
    return joined.select(*keys, *[pick(c).alias(c) for c in values], change.alias("change"))


def add_images(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Images by place and address, stored ones first; each place has one primary image."""
    both = stored.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    once = both.groupBy("place_id", "image_url").agg(F.min("age").alias("age"), F.max(F.col("is_primary") & (F.col("age") == 0)).alias("was_primary"))
    first = Window.partitionBy("place_id").orderBy(F.desc("was_primary"), "age", "image_url")
    return once.select("place_id", "image_url", (F.row_number().over(first) == 1).alias("is_primary"))


def replace_slice(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` with the slices of all keys in ``new`` replaced."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_sliced(df: DataFrame, path: str, key: str) -> None:
    """Write a table cut into one folder for each value of ``key``."""
    df.repartition(key).write.partitionBy(key).parquet(path)


def overwrite_slices(new: DataFrame, path: str, key: str) -> None:
    """Replace the slices of a table written by :func:`write_sliced` that ``new`` has rows of; the others keep their files.

    A slice of which ``new`` has no row stays as well. Slices are swapped when the whole write has succeeded.
    """
    new.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def remove(ids: DataFrame, children: dict[str, DataFrame], links: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Child rows of removed ids go; links to them become null."""
    gone = ids.select("place_id").distinct()
    out = {name: df.join(gone, "place_id", "left_anti") for name, df in children.items()}
    for name, df in links.items():
        marked = df.join(gone.withColumn("_gone", F.lit(True)), "place_id", "left")
        out[name] = marked.withColumn("place_id", F.when(F.col("_gone").isNull(), F.col("place_id"))).select(*df.columns)
    return out


def absorb(children: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows of absorbed places point to their keeper; rows that then agree in ``keys`` become one."""
    moved = children.join(mapping.select(F.col("place_id").alias("_old"), "keeper"), F.col("place_id") == F.col("_old"), "left")
    moved = moved.withColumn("place_id", F.coalesce("keeper", "place_id")).select(*children.columns)
    rest = [c for c in children.columns if c not in keys]
    return moved.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest])
