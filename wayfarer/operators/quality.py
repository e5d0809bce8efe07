"""Cleaning and validation of tabular records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.geo import number, valid_coordinates
from wayfarer.functions.score import clip
from wayfarer.functions.text import squeeze


def clean(df: DataFrame) -> DataFrame:
    """Exact copies and rows without a name go; missing numbers become 0 and missing texts "Unknown".

    Ratings, positions and fees may be texts: they become numbers, null where they are none, but a fee that is none is 0.
    Ratings are clipped to 0..5; a missing rating counts as 0 like any number, one that can't be read stays unknown.
    """
    measured = [c for c in ("rating", "latitude", "longitude", "entry_fee") if c in df.columns]
    named = df.dropDuplicates().where(F.trim(F.coalesce("place_name", F.lit(""))) != "")
    texts = [c for c, t in df.dtypes if t == "string" and c not in measured]
    numbers = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in ("latitude", "longitude")]
    filled = named.fillna(0, numbers).fillna("Unknown", texts)
    read = {c: number(F.col(c)) for c in measured}
    read |= {"rating": clip(read["rating"], 0, 5)} if "rating" in read else {}
    read |= {"entry_fee": F.coalesce(read["entry_fee"], F.lit(0.0))} if "entry_fee" in read else {}
    return filled.withColumns(read | {c: squeeze(F.col(c)) for c in texts})


def normalize(df: DataFrame) -> DataFrame:
    """Ratings within 0..5, whole counts, rounded coordinates inside the box, single blanks."""
    at = valid_coordinates(F.col("latitude"), F.col("longitude"))
    out = df.withColumn("_at", at).withColumns({"latitude": F.col("_at.latitude"), "longitude": F.col("_at.longitude")}).drop("_at")
    if "rating" in df.columns:
        out = out.withColumn("rating", clip(F.coalesce(number(F.col("rating")), F.lit(0.0)), 0.0, 5.0))
    if "rating_count" in df.columns:
        out = out.withColumn("rating_count", F.greatest(F.coalesce(F.col("rating_count").try_cast("bigint"), F.lit(0)), F.lit(0)).cast("long"))
    return out.withColumns({c: squeeze(F.col(c)) for c, t in out.dtypes if t == "string"})


def broken_rules(df: DataFrame, required: list[str]) -> dict[str, Column]:
    """What each rule says is wrong with a row; a missing column breaks its rule for all rows."""
    lat, lon = F.col("latitude"), F.col("longitude")
    rules = {
        "latitude out of range": lat.isNotNull() & ~lat.between(-90, 90),
        "longitude out of range": lon.isNotNull() & ~lon.between(-180, 180),
        "half a position": lat.isNull() != lon.isNull(),
    }
    if "rating" in df.columns:
        rules["rating out of range"] = F.col("rating").isNotNull() & ~F.col("rating").between(0, 5)
    for c in required:
        rules[f"missing {c}"] = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") if c in df.columns else F.lit(True)
    return rules


def validate(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per rule with the number of rows that break it."""
    rules = broken_rules(df, required)
    counts = df.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n_rows")


def violations(df: DataFrame, required: list[str], key: str) -> DataFrame:
    """``key, rules``: the rows that break a rule, and the rules in order; sound rows have none."""
    said = F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in broken_rules(df, required).items()])
    return df.select(key, F.filter(said, lambda r: r.isNotNull()).alias("rules")).where(F.size("rules") > 0)
