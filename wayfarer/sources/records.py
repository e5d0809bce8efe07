"""Readers and writers of place records and of the raw formats they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException
from pyspark.sql.window import Window

from wayfarer.functions.text import name_key


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a ``.csv`` or ``.json`` path; broken rows become nulls, and a missing path is an empty table."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "json"):
        raise ValueError(f"{path}: neither csv nor json")
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE")
    try:
        return reader.option("header", True).option("escape", '"').csv(path) if kind == "csv" else reader.json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def write_records(df: DataFrame, path: str) -> bool:
    """Write to a ``.csv``, ``.json`` or ``.parquet`` path; an empty table isn't written."""
    if df.isEmpty():
        return False
    kind = path.rsplit(".", 1)[-1].lower()
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).option("escape", '"').csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()
    return True


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the missing ones of typed columns; a new ``name_key`` is filled from the name."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    if "name_key" in missing and "place_name" in df.columns:
        missing["name_key"] = name_key(F.col("place_name"))
    return df.withColumns(missing) if missing else df


ELEMENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("center", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])), T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Named map elements (one JSON object a line): nodes have a position, ways and relations a centre."""
    raw = spark.read.schema(ELEMENT).json(path)
    name = F.coalesce(F.col("tags")["name:en"], F.col("tags")["name"])
    return raw.where(name.isNotNull()).select(
        F.concat_ws("/", "type", "id").alias("element_id"), name.alias("place_name"), F.coalesce("lat", "center.lat").alias("latitude"), F.coalesce("lon", "center.lon").alias("longitude"),
        F.col("tags")["tourism"].alias("tourism"), F.col("tags")["wikidata"].alias("external_id"),
    )


def notable(tags: Column) -> Column:
    """Core features always count, common ones only with a mark of notability; lodging never does."""
    core = F.coalesce(tags["tourism"].isin("attraction", "museum", "viewpoint", "zoo", "theme_park") | tags["historic"].isNotNull(), F.lit(False))
    common = F.coalesce(tags["natural"].isNotNull() | tags["leisure"].isin("park", "garden") | tags["amenity"].isin("place_of_worship"), F.lit(False))
    marked = tags["wikidata"].isNotNull() | tags["wikipedia"].isNotNull() | tags["heritage"].isNotNull()
    lodging = F.coalesce(tags["tourism"].isin("hotel", "guest_house", "hostel", "motel", "apartment"), F.lit(False))
    return (core | (common & marked)) & ~lodging


def read_bindings(df: DataFrame, column: str, wanted: str, unwanted: str) -> DataFrame:
    """Entities from JSON query bindings: labelled, positioned, of a wanted type and of no unwanted one."""
    value = T.StructType([T.StructField("value", T.StringType())])
    schema = T.StructType([T.StructField(c, value) for c in ("place", "placeLabel", "coord", "types", "img")])
    b = df.select(F.from_json(column, schema).alias("b"))
    types = F.split(F.coalesce("b.types.value", F.lit("")), r"\|")
    point = r"Point\(([-0-9.]+) ([-0-9.]+)\)"
    rows = b.where(~F.col("b.placeLabel.value").rlike(r"^Q\d+$"))
    rows = rows.where(F.exists(types, lambda t: t.rlike(wanted)) & ~F.exists(types, lambda t: t.rlike(unwanted)))
    return rows.select(
        F.regexp_extract("b.place.value", r"(Q\d+)$", 1).alias("external_id"), F.col("b.placeLabel.value").alias("place_name"),
        F.regexp_extract("b.coord.value", point, 2).try_cast("double").alias("latitude"), F.regexp_extract("b.coord.value", point, 1).try_cast("double").alias("longitude"),
    )


def read_gazetteer(spark: SparkSession, path: str, districts: DataFrame, kinds: dict[str, tuple[str, int]]) -> DataFrame:
    """Gazetteer lines (tab-separated: id, name, plain name, other names, lat, lon, code, admin) with their districts.

    ``districts`` maps admin codes to names; ``kinds`` feature codes to a kind and its rank.
    """
    raw = spark.read.option("sep", "\t").option("quote", "").schema("id long, name string, ascii string, other string, lat double, lon double, code string, admin string").csv(path)
    names = F.array_distinct(F.filter(F.concat(F.array("ascii", "name"), F.split(F.coalesce("other", F.lit("")), ",")), lambda n: n.isNotNull() & (n != "")))
    kind = F.coalesce(*[F.when(F.col("code") == c, F.lit(k)) for c, (k, _) in kinds.items()])
    rank = F.coalesce(*[F.when(F.col("code") == c, F.lit(r)) for c, (_, r) in kinds.items()])
    rows = raw.withColumns({"kind": kind, "rank": rank, "names": names}).where("kind IS NOT NULL")
    return rows.join(F.broadcast(districts), "admin").select("district", "kind", "rank", "lat", "lon", "names")  # a row per admin code


def read_listing(lines: DataFrame) -> DataFrame:
    """Items of a numbered listing (``part, line_no, line``) under the last region header of their part."""
    header = F.nullif(F.regexp_extract("line", r"^Region: (.+)$", 1), F.lit(""))
    carried = F.last(header, ignorenulls=True).over(Window.partitionBy("part").orderBy("line_no"))
    item = r"^(\d+)\. (.*?) \[(\d+)\]$"
    rows = lines.withColumn("region", carried).where(F.col("line").rlike(item))
    return rows.select("region", F.regexp_extract("line", item, 1).cast("long").alias("serial"), F.regexp_extract("line", item, 2).alias("name"), F.regexp_extract("line", item, 3).cast("long").alias("pin"))


def holidays_or_override(file_rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """File rows win when there are any; a day's ``;``-joined names become one row each."""
    each = calendar.select("holiday_date", F.explode(F.split("names", r"\s*;\s*")).alias("name"))
    used = file_rows.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit(True).alias("_none"))
    return file_rows.select("holiday_date", "name").unionByName(each.join(F.broadcast(used), how="cross").drop("_none"))


def run_report(outcomes: DataFrame) -> DataFrame:
    """Rows and status of each source."""
    return outcomes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("ok").alias("n_ok"), F.when(F.bool_and("ok"), "ok").otherwise("partial").alias("status"))
