"""Queries of sources and sinks, cleaning, entity resolution, upserts and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.operators import locating as V, nearby, quality as C, refresh as W, resolve as E, spelling as Y, upsert as U
from wayfarer.plans.language import KEY_SQL
from wayfarer.plans.registry import query
from wayfarer.plans.travel import km
from wayfarer.session import scratch_path, written
from wayfarer.sources import records as IO
from wayfarer.sources.tables import view, with_views
from wayfarer.streaming import streams as ST


@query("io1_io2_records_csv", with_views("SELECT place_id, place_name, district, latitude FROM places", "places"))
def io12(spark, sf_dir):
    df = view(spark, sf_dir, "places").select("place_id", "place_name", "district", "latitude")
    path = scratch_path(spark, "records") + ".csv"
    IO.write_records(df, path)
    return IO.read_records(spark, path, df.schema)


@query("io3_scan_first", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey LIMIT 1")
def io3(spark, sf_dir):
    return spark.sql("SELECT n_nationkey, n_name FROM {nation} WHERE n_regionkey = :r ORDER BY n_nationkey LIMIT 1", args={"r": 2}, nation=view(spark, sf_dir, "nation"))


@query("io4_append", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name) FROM nation")
def io4(spark, sf_dir):
    df, path = view(spark, sf_dir, "nation").select("n_nationkey", "n_name"), scratch_path(spark, "append")
    IO.append(df, path)
    IO.append(df.select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.upper("n_name").alias("n_name")), path)
    return spark.read.schema(df.schema).parquet(path)


@query("io5_evolve", with_views("SELECT place_id, lower(replace(place_name, '#', ' ')) AS name_key, CAST(NULL AS VARCHAR) AS osm_id FROM places", "places"))
def io5(spark, sf_dir):
    return IO.evolve(view(spark, sf_dir, "places"), {"place_name": "string", "name_key": "string", "osm_id": "string"}).select("place_id", "name_key", "osm_id")


@query("io6_elements", with_views("SELECT concat(CASE WHEN place_id % 2 = 0 THEN 'node' ELSE 'way' END, '/', place_id) AS element_id, place_name, latitude, longitude, category_name AS tourism FROM places WHERE place_id % 9 <> 0", "places"))
def io6(spark, sf_dir):
    even = F.col("place_id") % 2 == 0
    name = F.when(F.col("place_id") % 9 != 0, F.col("place_name"))
    at = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    element = F.struct(F.when(even, "node").otherwise("way").alias("type"), F.col("place_id").alias("id"), F.when(even, F.col("latitude")).alias("lat"), F.when(even, F.col("longitude")).alias("lon"), F.when(~even, at).alias("center"), F.create_map(F.lit("name"), name, F.lit("tourism"), F.col("category_name")).alias("tags"))
    path = scratch_path(spark, "elements")
    view(spark, sf_dir, "places").select(F.to_json(element).alias("value")).write.text(path)
    return IO.read_elements(spark, path).select("element_id", "place_name", "latitude", "longitude", "tourism")


@query("io7_bindings", with_views("SELECT concat('Q', place_id) AS external_id, place_name, latitude, longitude FROM places WHERE place_id % 7 <> 0 AND category_name NOT IN ('SMALL', 'ECONOMY')", "places"))
def io7(spark, sf_dir):
    v = lambda c: F.struct(c.alias("value"))
    label = F.when(F.col("place_id") % 7 == 0, F.concat(F.lit("Q"), "place_id")).otherwise(F.col("place_name"))
    coord = F.concat(F.lit("Point("), "longitude", F.lit(" "), "latitude", F.lit(")"))
    types = F.concat(F.lit("place|"), "category_name")
    doc = F.to_json(F.struct(v(F.concat(F.lit("http://entity/Q"), "place_id")).alias("place"), v(label).alias("placeLabel"), v(coord).alias("coord"), v(types).alias("types")))
    return IO.read_bindings(view(spark, sf_dir, "places").select(doc.alias("b")), "b", "^place$", "^(SMALL|ECONOMY)$")


@query("io8_io13_gazetteer", with_views("SELECT district, CASE WHEN category_name = 'PROMO' THEN 'town' ELSE 'village' END AS kind, CAST(CASE WHEN category_name = 'PROMO' THEN 1 ELSE 2 END AS INTEGER) AS rank, latitude AS lat, longitude AS lon, upper(place_name) AS first_name FROM places WHERE category_name IN ('PROMO', 'LARGE') AND latitude IS NOT NULL", "places"))
def io8(spark, sf_dir):
    path = scratch_path(spark, "gazetteer")
    line = F.concat_ws("\t", F.col("place_id").cast("string"), "place_name", F.upper("place_name"), F.lower("place_name"), F.col("latitude").cast("string"), F.col("longitude").cast("string"), "category_name", "district")
    view(spark, sf_dir, "places").where("latitude IS NOT NULL").select(line).write.text(path)
    admin = view(spark, sf_dir, "nation").select(F.col("n_name").alias("admin"), F.col("n_name").alias("district"))
    rows = IO.read_gazetteer(spark, path, admin, {"PROMO": ("town", 1), "LARGE": ("village", 2)})
    return rows.select("district", "kind", "rank", "lat", "lon", F.col("names")[0].alias("first_name"))


@query("io10_w7_listing", with_views("SELECT district AS region, CAST(row_number() OVER (PARTITION BY district ORDER BY place_id) AS BIGINT) AS serial, place_name AS name, place_id AS pin FROM places", "places"))
def io10(spark, sf_dir):
    df = view(spark, sf_dir, "places")
    items = df.select(F.col("district").alias("part"), F.row_number().over(Window.partitionBy("district").orderBy("place_id")).alias("line_no"), "place_name", "place_id")
    items = items.select("part", "line_no", F.concat(F.col("line_no"), F.lit(". "), "place_name", F.lit(" ["), "place_id", F.lit("]")).alias("line"))
    heads = df.select(F.col("district").alias("part")).distinct().select("part", F.lit(0).alias("line_no"), F.concat(F.lit("Region: "), "part").alias("line"))
    return IO.read_listing(items.unionByName(heads))


@query("io11_holidays", with_views("SELECT start_date AS holiday_date, unnest(string_split(string_agg(festival_name, ';' ORDER BY festival_id), ';')) AS name FROM festivals WHERE start_date IS NOT NULL GROUP BY start_date", "festivals"))
def io11(spark, sf_dir):
    dated = view(spark, sf_dir, "festivals").where("start_date IS NOT NULL")
    days = dated.groupBy(F.col("start_date").alias("holiday_date")).agg(F.array_join(F.collect_list("festival_name"), "; ").alias("names"))
    none = dated.where("false").select(F.col("start_date").alias("holiday_date"), F.col("festival_name").alias("name"))
    return IO.holidays_or_override(none, days)


@query("io12_run_report", with_views("SELECT source_id AS source, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE external_id IS NOT NULL) AS BIGINT) AS n_ok, CASE WHEN bool_and(external_id IS NOT NULL) THEN 'ok' ELSE 'partial' END AS status FROM source_records GROUP BY source_id", "source_records"))
def io12_report(spark, sf_dir):
    return IO.run_report(view(spark, sf_dir, "source_records").select(F.col("source_id").alias("source"), F.col("external_id").isNotNull().alias("ok")))


@query("f12_notable_poi", with_views("SELECT place_id FROM places WHERE (category_name = 'PROMO' OR (category_name = 'LARGE' AND place_id % 3 = 0))", "places"))
def f12(spark, sf_dir):
    tags = F.create_map(F.lit("tourism"), F.when(F.col("category_name") == "PROMO", "museum").when(F.col("category_name") == "SMALL", "hotel"), F.lit("natural"), F.when(F.col("category_name").isin("LARGE", "SMALL"), "peak"), F.lit("wikidata"), F.when(F.col("place_id") % 3 == 0, "Q1"))
    return view(spark, sf_dir, "places").withColumn("tags", tags).where(IO.notable(F.col("tags"))).select("place_id")


@query("er1_clean", with_views("SELECT place_id, trim(regexp_replace(place_name, '\\s+', ' ', 'g')) AS place_name, coalesce(entry_fee, 0) AS entry_fee, CASE WHEN place_id % 4 = 1 THEN NULL ELSE least(greatest(popularity_score / 12 - 1, 0), 5) END AS rating, CASE WHEN place_id % 6 <> 0 THEN latitude END AS latitude FROM places", "places"))
def er1(spark, sf_dir):
    """Fees with gaps, ratings as texts of which some are none and some out of range, positions as texts."""
    rating = F.when(F.col("place_id") % 4 == 1, "good").otherwise((F.col("popularity_score") / 12 - 1).cast("string"))
    latitude = F.when(F.col("place_id") % 6 == 0, "north").otherwise(F.col("latitude").cast("string"))
    df = view(spark, sf_dir, "places").select("place_id", "place_name", "entry_fee", rating.alias("rating"), latitude.alias("latitude"))
    blank = df.limit(5).withColumn("place_name", F.lit("  "))
    return C.clean(df.unionByName(df).unionByName(blank))


@query("er2_normalize", with_views("SELECT place_id, CASE WHEN ok THEN round(latitude, 6) END AS latitude, CASE WHEN ok THEN round(longitude, 6) END AS longitude, least(greatest(popularity_score / 10, 0), 5) AS rating FROM (SELECT *, latitude BETWEEN 8.0 AND 13.6 AND longitude BETWEEN 76.0 AND 80.5 AS ok FROM places)", "places"))
def er2(spark, sf_dir):
    return C.normalize(view(spark, sf_dir, "places").select("place_id", "latitude", "longitude", (F.col("popularity_score") / 10).alias("rating")))


@query("er3_validate", with_views("SELECT rule, CAST(n AS BIGINT) AS n_rows FROM (SELECT count(*) FILTER (WHERE latitude < -90 OR latitude > 90) AS \"latitude out of range\", count(*) FILTER (WHERE longitude < -180 OR longitude > 180) AS \"longitude out of range\", count(*) FILTER (WHERE (latitude IS NULL) <> (longitude IS NULL)) AS \"half a position\", count(*) FILTER (WHERE place_name IS NULL OR trim(place_name) = '') AS \"missing place_name\", count(*) FILTER (WHERE entry_fee IS NULL) AS \"missing entry_fee\", count(*) AS \"missing address\" FROM places) UNPIVOT (n FOR rule IN (\"latitude out of range\", \"longitude out of range\", \"half a position\", \"missing place_name\", \"missing entry_fee\", \"missing address\"))", "places"))
def er3(spark, sf_dir):
    return C.validate(view(spark, sf_dir, "places"), ["place_name", "entry_fee", "address"])


@query("er3_violations", with_views("""SELECT place_id, list_filter([CASE WHEN latitude < 9 THEN 'latitude out of range' END, CASE WHEN rating > 5 THEN 'rating out of range' END, CASE WHEN entry_fee IS NULL THEN 'missing entry_fee' END], lambda x: x IS NOT NULL) AS rules
FROM (SELECT place_id, latitude, popularity_score / 12 AS rating, entry_fee FROM places) WHERE coalesce(latitude < 9, FALSE) OR rating > 5 OR entry_fee IS NULL""", "places"))
def er3_rows(spark, sf_dir):
    """The rows behind the counts: positions below the ninth degree are moved off the globe, and ratings reach beyond five."""
    df = view(spark, sf_dir, "places").withColumns({"rating": F.col("popularity_score") / 12, "latitude": F.when(F.col("latitude") < 9, 100.0).otherwise(F.col("latitude"))})
    return C.violations(df, ["entry_fee"], "place_id")


def numbered(spark, sf_dir):
    """Source records with a row id that any run gives alike, and with the positions, aliases and images of their sources.

    A third of the sources has no positions, and some lie kilometres off, so that namesakes of a district stay apart.
    """
    df = view(spark, sf_dir, "source_records")
    place = view(spark, sf_dir, "places").select(F.col("place_id").alias("record_key"), F.col("latitude").alias("y"), F.col("longitude").alias("x"), "category_name")
    off = (F.col("source_id") % 3 - 1) * 0.04
    some = F.col("source_id") % 3 != 1
    rows = df.join(place, "record_key").withColumns({
        "rid": F.xxhash64("record_key", "source_id").bitwiseAND(F.lit((1 << 63) - 1)),
        "latitude": F.when(some, F.col("y") + off), "longitude": F.when(some, F.col("x")),
        "aliases": F.when(F.col("source_id") % 5 == 0, F.concat(F.lit("Old "), "place_name", F.lit("|"), F.lower("place_name"))),
        "map_id": F.when(F.col("source_id") % 11 == 0, F.concat(F.lit("way/"), "record_key")),
        "source_url": F.when(F.col("source_id") % 3 == 0, F.concat(F.lit("https://www.openstreetmap.org/way/"), "record_key")).otherwise(F.concat(F.lit("src"), "source_id")),
        "tourism_relevance": (F.col("source_id") % 10) / 10.0,
        "image_url": F.when(F.col("source_id") % 4 != 0, F.concat(F.lit("https://img.example/"), "record_key", F.lit("/"), F.col("source_id") % 6)),
        "image_source": F.when(F.col("source_id") % 2 == 0, "Wikimedia Commons").otherwise("District"),
    })
    return written(rows.drop("x", "y"), "records")


@query("er4_merge_records")
def er4(spark, sf_dir):
    return E.merge_records(numbered(spark, sf_dir))


@query("er6_survivorship")
def er6(spark, sf_dir):
    rows = numbered(spark, sf_dir)
    return E.survivors(rows, E.merge_records(rows), ["place_name", "district", "external_id", "map_id", "source_url"])


@query("er5_attach_unlocated")
def er5(spark, sf_dir):
    """Groups of merged records without a position and those with one."""
    rows = numbered(spark, sf_dir)
    pairs = E.attach_unlocated(E.groups_of(rows, E.merge_records(rows)))
    return pairs.select("u", "l", F.round("score", 6).alias("score"))


def spelt(spark, sf_dir):
    """Places, every other one spelt with another voicing, as transliterations differ; some name their village."""
    plain = F.translate("place_name", "#0123456789", "")
    name = F.when(F.col("place_id") % 2 == 1, F.translate(plain, "gb", "kp")).otherwise(plain)
    name = F.when(F.col("place_id") % 7 == 0, F.concat(name, F.lit(", "), "category_name")).otherwise(name)
    df = view(spark, sf_dir, "places").select("place_id", "district", "latitude", "longitude", "popularity_score", name.alias("place_name"))
    counts = view(spark, sf_dir, "place_sources").groupBy("place_id").agg(F.count(F.lit(1)).alias("source_count"))
    extra = {"location_precision": F.when(F.col("place_id") % 10 == 3, "locality"), "merged_names": F.lit(None).cast("string"), "source_count": F.coalesce("source_count", F.lit(0))}
    return df.join(counts, "place_id", "left").withColumns(extra)


@query("er7_er8_spelling_pairs")
def er7(spark, sf_dir):
    return Y.spelling_pairs(spelt(spark, sf_dir)).select("later", "earlier")


@query("er8_spelling_clusters")
def er8(spark, sf_dir):
    return Y.spelling_clusters(spelt(spark, sf_dir))


NEAR = f"(({km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}) IS NULL OR ({km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}) <= 15)"


@query("er9_cross_district", with_views(f""", k AS (SELECT *, {KEY_SQL} AS name_key FROM places),
pairs AS (SELECT a.place_id AS ia, a.latitude IS NULL AS xa, -a.popularity_score AS pa, b.place_id AS ib, b.latitude IS NULL AS xb, -b.popularity_score AS pb
  FROM k a JOIN related_districts r ON r.district = a.district JOIN k b ON b.district = r.related AND b.name_key = a.name_key WHERE a.place_id <> b.place_id AND a.name_key <> '' AND {NEAR}),
best AS (SELECT *, row_number() OVER (PARTITION BY ia ORDER BY xb, pb, ib) AS nth FROM pairs)
SELECT ia AS place_id, ib AS keeper FROM best WHERE nth = 1 AND (xb, pb, ib) < (xa, pa, ia)""", "places", "related_districts"))
def er9(spark, sf_dir):
    return E.cross_district_duplicates(view(spark, sf_dir, "places"), view(spark, sf_dir, "related_districts"))


@query("er10_locate")
def er10(spark, sf_dir):
    """Places without a position are looked for among the others; every other one names a village, spelt differently."""
    df = view(spark, sf_dir, "places")
    towns = df.select((F.col("place_id") - 25).alias("place_id"), F.translate("place_name", "ag", "ek").alias("city_town")).where("place_id % 2 = 0")
    asked = df.where("latitude IS NULL").select("place_id", "place_name", "district", (F.col("category_name") == "PROMO").alias("is_temple")).join(towns, "place_id", "left")
    kind = F.when(F.col("category_name") == "PROMO", "worship").otherwise("settlement")
    known = df.where("latitude IS NOT NULL").select(F.col("place_id").alias("worship_id"), "district", kind.alias("kind"), (F.col("place_id") % 4).alias("rank"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.array(F.upper("place_name")).alias("names"))
    return V.locate(asked, known, view(spark, sf_dir, "related_districts"))


def stored_tables(spark, sf_dir) -> W.Tables:
    """The stored tables: places with the name of their category, and all that hangs on them."""
    get = lambda name: view(spark, sf_dir, name)
    places = get("place_table").join(get("categories").select("category_id", "category_name"), "category_id", "left").drop("category_id", "source_id")
    images = get("images").groupBy("place_id", "image_url").agg(F.bool_or("is_primary").alias("is_primary"), F.min("source_id").alias("s"))
    images = images.select("place_id", "image_url", F.concat(F.lit("s"), "s").alias("image_source"), F.when(F.col("s") % 2 == 0, "CC BY").alias("image_license"), F.lit(None).cast("string").alias("image_author"), "is_primary")
    sources = get("place_sources").select("place_id", "source_id", F.lit("").alias("source_url"), "last_seen")
    festivals = get("festivals").withColumn("associated_place_id", F.when(F.col("festival_id") % 7 == 0, F.col("festival_id") % 1000))
    children = {"ratings": get("ratings"), "place_status": get("place_status"), "crowd_data": get("crowd_data")}
    return W.Tables(places, sources, images, children, get("place_features"), festivals)


IMAGES_SQL = "stored_images AS (SELECT place_id, image_url, concat('s', CAST(min(source_id) AS VARCHAR)) AS image_source, CASE WHEN min(source_id) % 2 = 0 THEN 'CC BY' END AS image_license, bool_or(is_primary) AS is_primary FROM images GROUP BY place_id, image_url)"
EVENTS_SQL = "events_of AS (SELECT *, CASE WHEN festival_id % 7 = 0 THEN festival_id % 1000 END AS associated_place_id FROM festivals)"


def _kinds(tables: W.Tables):
    """All tables as ``kind, place_id, item``, for a comparison of whole rows."""
    text = lambda *c: F.concat_ws("/", *[F.coalesce(F.col(x).cast("string"), F.lit("-")) if isinstance(x, str) else x for x in c]).alias("item")
    day = F.date_format("last_seen", "yyyy-MM-dd")
    parts = [
        ("place", tables.places.select("place_id", text("place_name", *W.LENT, "description", "merged_names", F.coalesce(F.format_number("tourism_relevance", 2), F.lit("-"))))), ("source", tables.sources.select("place_id", text("source_id", day))),
        ("image", tables.images.select("place_id", text("image_url", "image_source", "image_license", "is_primary"))), ("rating", tables.children["ratings"].select("place_id", text(F.col("source_id").cast("string")))),
        ("status", tables.children["place_status"].select("place_id", text("status_id"))), ("crowd", tables.children["crowd_data"].select("place_id", text("visit_id"))), ("feature", tables.features.select("place_id", text("feature"))),
        ("event", tables.events.select(F.col("associated_place_id").alias("place_id"), text("festival_id"))),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "place_id", "item") for kind, df in parts])


def _item_sql(*columns: str) -> str:
    return "concat_ws('/', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


#: Every third place keeps; the two behind it go into it.
ABSORB_SQL = f""", {IMAGES_SQL}, {EVENTS_SQL},
rows AS (SELECT *, place_id - place_id % 3 AS root FROM place_table),
places_now AS (SELECT root, min_by(place_name, place_id) AS place_name, {", ".join(f"min_by({c}, place_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in W.LENT)},
  min_by(description, struct_pack(l := -length(coalesce(description, '')), place_id)) AS description,
  string_agg(CASE WHEN place_id = root THEN merged_names ELSE concat_ws('|', place_name, merged_names) END, '|' ORDER BY place_id) AS merged_names,
  CASE WHEN count(*) = 1 THEN max(tourism_relevance) ELSE max(coalesce(tourism_relevance, 0)) END AS relevance FROM rows GROUP BY root),
pictures AS (SELECT root, image_url, min(place_id) AS owner, min_by(image_source, place_id) AS image_source, min_by(image_license, place_id) AS image_license, min_by(is_primary, place_id) AS is_primary
  FROM (SELECT *, place_id - place_id % 3 AS root FROM stored_images) GROUP BY root, image_url),
leads AS (SELECT *, is_primary AND owner = min(owner) FILTER (WHERE is_primary) OVER (PARTITION BY root) AS lead FROM pictures)
SELECT 'place' AS kind, root AS place_id, {_item_sql("place_name", *W.LENT, "description", "merged_names", "printf('%.2f', relevance)")} AS item FROM places_now
UNION ALL SELECT 'source', root, {_item_sql("source_id", "strftime(last_seen, '%Y-%m-%d')")} FROM (SELECT place_id - place_id % 3 AS root, source_id, min_by(last_seen, place_id) AS last_seen FROM place_sources GROUP BY 1, 2)
UNION ALL SELECT 'image', root, {_item_sql("image_url", "image_source", "image_license", "coalesce(lead, FALSE)")} FROM leads
UNION ALL SELECT 'rating', place_id - place_id % 3, CAST(source_id AS VARCHAR) FROM ratings
UNION ALL SELECT 'status', CASE WHEN place_id IN (SELECT place_id FROM place_table) THEN place_id - place_id % 3 ELSE place_id END, CAST(status_id AS VARCHAR) FROM place_status
UNION ALL SELECT 'crowd', place_id - place_id % 3, CAST(visit_id AS VARCHAR) FROM crowd_data
UNION ALL SELECT 'feature', place_id, feature FROM place_features WHERE place_id % 3 = 0
UNION ALL SELECT 'event', CASE WHEN associated_place_id IN (SELECT place_id FROM place_table) THEN associated_place_id - associated_place_id % 3 ELSE associated_place_id END, CAST(festival_id AS VARCHAR) FROM events_of"""


@query("er11_absorb", with_views(ABSORB_SQL, "place_table", "categories", "images", "place_sources", "ratings", "place_status", "crowd_data", "place_features", "festivals"))
def er11(spark, sf_dir):
    tables = stored_tables(spark, sf_dir)
    mapping = tables.places.where("place_id % 3 <> 0").select("place_id", (F.col("place_id") - F.col("place_id") % 3).alias("keeper"))
    return _kinds(W.absorb(tables, mapping))


#: Records of a run: every other place, some under another spelling, some filed under a related district.
NEW_SQL = """first_related AS (SELECT district, min(related) AS other FROM related_districts GROUP BY district),
new_records AS (SELECT place_id + 1000000 AS new_id, CASE WHEN place_id % 8 = 0 THEN concat('Sri ', place_name) ELSE upper(place_name) END AS place_name, CASE WHEN place_id % 10 = 4 THEN other ELSE p.district END AS district, category_name,
  CASE WHEN place_id % 6 = 0 THEN NULL ELSE city_town END AS city_town, 'New ' || subcategory AS subcategory, CASE WHEN place_id % 4 = 0 THEN p.description || ', seen again' END AS description,
  CASE WHEN place_id % 4 <> 2 THEN latitude + 0.01 END AS latitude, CASE WHEN place_id % 4 <> 2 THEN longitude END AS longitude, address, external_id, map_id, source_url, 0.45 AS tourism_relevance
  FROM place_table p LEFT JOIN categories USING (category_id) LEFT JOIN first_related r ON r.district = p.district WHERE place_id % 2 = 0)"""


def new_records(spark, sf_dir):
    get = lambda name: view(spark, sf_dir, name)
    k = F.col("place_id")
    other = get("related_districts").groupBy("district").agg(F.min("related").alias("other"))
    df = get("place_table").where("place_id % 2 = 0").join(get("categories").select("category_id", "category_name"), "category_id", "left").join(other, "district", "left")
    return df.select(
        (k + 1000000).alias("new_id"), F.when(k % 8 == 0, F.concat(F.lit("Sri "), "place_name")).otherwise(F.upper("place_name")).alias("place_name"), F.when(k % 10 == 4, F.col("other")).otherwise(F.col("district")).alias("district"), "category_name",
        F.when(k % 6 != 0, F.col("city_town")).alias("city_town"), F.concat(F.lit("New "), "subcategory").alias("subcategory"), F.when(k % 4 == 0, F.concat("description", F.lit(", seen again"))).alias("description"),
        F.when(k % 4 != 2, F.col("latitude") + 0.01).alias("latitude"), F.when(k % 4 != 2, F.col("longitude")).alias("longitude"), "address", "external_id", "map_id", "source_url", F.lit(0.45).alias("tourism_relevance"),
    )


def key_sql(alias: str) -> str:
    return KEY_SQL.replace("place_name", f"{alias}.place_name")


_FIELDS = ["place_name", "district", "category_name", *W.OPTIONAL]
UPSERT_SQL = f""", {NEW_SQL},
stored AS (SELECT p.*, c.category_name FROM place_table p LEFT JOIN categories c USING (category_id) WHERE place_id % 3 <> 0),
old AS (SELECT s.*, {key_sql("s")} AS name_key FROM stored s), fresh AS (SELECT n.*, {key_sql("n")} AS name_key FROM new_records n),
by_id AS (SELECT new_id, min(o.place_id) AS place_id FROM fresh n JOIN old o ON o.external_id = n.external_id GROUP BY new_id),
by_map AS (SELECT new_id, min(o.place_id) AS place_id FROM fresh n JOIN old o ON o.map_id = n.map_id WHERE new_id NOT IN (SELECT new_id FROM by_id) GROUP BY new_id),
by_name AS (SELECT new_id, min(o.place_id) AS place_id FROM fresh n JOIN old o ON o.district = n.district AND o.name_key = n.name_key WHERE n.name_key <> '' AND new_id NOT IN (SELECT new_id FROM by_id UNION ALL SELECT new_id FROM by_map) GROUP BY new_id),
by_related AS (SELECT new_id, min(o.place_id) AS place_id FROM fresh n JOIN related_districts r ON r.district = n.district JOIN old o ON o.district = r.related AND o.name_key = n.name_key
  WHERE n.name_key <> '' AND new_id NOT IN (SELECT new_id FROM by_id UNION ALL SELECT new_id FROM by_map UNION ALL SELECT new_id FROM by_name) AND coalesce({km("n.latitude", "n.longitude", "o.latitude", "o.longitude")} <= 15, TRUE) GROUP BY new_id HAVING count(*) = 1),
matched AS (SELECT *, FALSE AS far FROM by_id UNION ALL SELECT *, FALSE FROM by_map UNION ALL SELECT *, FALSE FROM by_name UNION ALL SELECT *, TRUE FROM by_related),
told AS (SELECT n.* REPLACE (CASE WHEN far THEN NULL ELSE n.district END AS district), m.place_id, CASE WHEN m.place_id IS NULL THEN concat(n.district, '/', n.name_key) END AS added FROM fresh n LEFT JOIN matched m USING (new_id)),
last AS (SELECT place_id, added, {", ".join(f"arg_max({c}, new_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _FIELDS)}, max(tourism_relevance) AS tourism_relevance FROM told GROUP BY place_id, added)
SELECT o.place_id, {", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in _FIELDS if c not in ("latitude", "longitude"))}, round(coalesce(n.latitude, o.latitude), 6) AS latitude, CASE WHEN n.latitude IS NULL THEN o.location_precision END AS location_precision,
  CASE WHEN n.tourism_relevance IS NULL THEN o.tourism_relevance ELSE greatest(coalesce(o.tourism_relevance, 0), n.tourism_relevance) END AS tourism_relevance, CASE WHEN o.place_id IS NULL THEN 'Home State' ELSE o.state END AS state,
  CASE WHEN o.place_id IS NULL THEN 'insert' WHEN n.tourism_relevance IS NULL THEN 'keep' ELSE 'update' END AS change
FROM old o FULL JOIN last n ON n.place_id = o.place_id"""


@query("er13_upsert_places", with_views(UPSERT_SQL, "place_table", "categories", "related_districts"))
def er13(spark, sf_dir):
    """Records matched by a cascade of keys update the snapshot field by field; those that match nothing become places."""
    stored = stored_tables(spark, sf_dir).places.where("place_id % 3 <> 0")
    up = W.upsert_places(stored, new_records(spark, sf_dir), view(spark, sf_dir, "related_districts"), "Home State").places
    columns = [c for c in _FIELDS if c not in ("latitude", "longitude")]
    return up.select(F.when(F.col("change") != "insert", F.col("place_id")).alias("place_id"), *columns, F.round("latitude", 6).alias("latitude"), "location_precision", "tourism_relevance", "state", "change")


@query("er14_upsert_images", with_views("""SELECT place_id, image_url, row_number() OVER (PARTITION BY place_id ORDER BY was DESC, age, image_url) = 1 AS is_primary FROM (
SELECT place_id, image_url, min(age) AS age, max(CASE WHEN is_primary AND age = 0 THEN 1 ELSE 0 END) AS was FROM (
SELECT place_id, image_url, is_primary, 0 AS age FROM images WHERE place_id % 2 = 0 UNION ALL SELECT place_id, image_url, is_primary, 1 FROM images) GROUP BY place_id, image_url)""", "images"))
def er14(spark, sf_dir):
    df = view(spark, sf_dir, "images").select("place_id", "image_url", "is_primary")
    return U.add_images(df.where("place_id % 2 = 0"), df)


@query("er14_upsert_tables", with_views("""SELECT 'source' AS kind, s_name AS key, CASE WHEN s_suppkey % 2 = 0 THEN concat('url', CAST(s_suppkey AS VARCHAR)) ELSE 'old' END AS value, CASE WHEN s_suppkey % 4 = 0 THEN 'CC0' WHEN s_suppkey % 3 <> 0 THEN 'ODbL' END AS note FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0
UNION ALL SELECT 'seen', concat(CAST(place_id AS VARCHAR), '/', CAST(source_id AS VARCHAR)), strftime(CASE WHEN source_id % 2 = 0 THEN DATE '2030-01-01' ELSE last_seen END, '%Y-%m-%d'), NULL FROM place_sources
UNION ALL SELECT 'holiday', concat(festival_name, '/', strftime(start_date, '%Y-%m-%d')), CASE WHEN max(festival_id % 2) = 1 THEN 'new' ELSE 'old' END, NULL FROM festivals WHERE start_date IS NOT NULL GROUP BY festival_name, start_date""", "place_sources", "festivals"))
def er14_tables(spark, sf_dir):
    """Sources by name, sightings by place and source, and holidays by name and day."""
    get = lambda name: view(spark, sf_dir, name)
    k = F.col("s_suppkey")
    old = get("supplier").where("s_suppkey % 3 <> 0").select(k.alias("source_id"), F.col("s_name").alias("source_name"), F.lit("old").alias("source_url"), F.lit("ODbL").alias("license"))
    new = get("supplier").where("s_suppkey % 2 = 0").select(F.col("s_name").alias("source_name"), F.concat(F.lit("url"), k).alias("source_url"), F.when(k % 4 == 0, "CC0").alias("license"))
    sources = written(W.upsert_sources(old, new), "er14-sources").select(F.lit("source").alias("kind"), F.col("source_name").alias("key"), F.col("source_url").alias("value"), F.col("license").alias("note"))
    seen = get("place_sources").select("place_id", "source_id", F.lit("").alias("source_url"), "last_seen")
    listed = seen.where("source_id % 2 = 0").groupBy("place_id").agg(F.collect_list(F.struct("source_id", F.lit(None).cast("string").alias("source_url"))).alias("sources")).withColumnRenamed("place_id", "new_id")
    ids = listed.select("new_id", F.col("new_id").alias("place_id"))
    after = W.upsert_place_sources(seen, listed, ids, F.lit("2030-01-01").cast(seen.schema["last_seen"].dataType))
    after = after.select(F.lit("seen").alias("kind"), F.concat_ws("/", "place_id", "source_id").alias("key"), F.date_format("last_seen", "yyyy-MM-dd").alias("value"), F.lit(None).cast("string").alias("note"))
    days = get("festivals").where("start_date IS NOT NULL").select("festival_name", "start_date", "festival_id")
    first = days.select("festival_name", "start_date", F.lit("old").alias("state")).distinct()
    holidays = W.upsert_keyed(first, days.where("festival_id % 2 = 1").select("festival_name", "start_date", F.lit("new").alias("state")), ["festival_name", "start_date"])
    holidays = holidays.select(F.lit("holiday").alias("kind"), F.concat_ws("/", "festival_name", F.date_format("start_date", "yyyy-MM-dd")).alias("key"), F.col("state").alias("value"), F.lit(None).cast("string").alias("note"))
    return sources.unionByName(after).unionByName(holidays)


@query("er15_replace_slice", with_views("SELECT festival_id, CASE WHEN month = 6 THEN upper(festival_name) ELSE festival_name END AS festival_name, month FROM festivals", "festivals"))
def er15(spark, sf_dir):
    """Festivals lie in slices by their source (here the month); a source's new list replaces its slice alone."""
    df, path = view(spark, sf_dir, "festivals").select("festival_id", "festival_name", "month"), scratch_path(spark, "er15")
    U.write_sliced(df, path, "month")
    U.overwrite_slices(df.where("month = 6").withColumn("festival_name", F.upper("festival_name")), path, "month")
    return spark.read.schema(df.schema).parquet(path)


@query("er16_remove_places", with_views(f""", {IMAGES_SQL}, {EVENTS_SQL}, gone AS (SELECT place_id FROM place_table WHERE place_id % 10 = 0 UNION SELECT place_id FROM ratings WHERE place_id % 10 = 0)
SELECT 'place' AS kind, place_id, {_item_sql("place_name")} AS item FROM place_table WHERE place_id NOT IN (SELECT place_id FROM gone)
UNION ALL SELECT 'source', place_id, CAST(source_id AS VARCHAR) FROM place_sources WHERE place_id NOT IN (SELECT place_id FROM gone) UNION ALL SELECT 'image', place_id, image_url FROM stored_images WHERE place_id NOT IN (SELECT place_id FROM gone)
UNION ALL SELECT 'rating', place_id, CAST(source_id AS VARCHAR) FROM ratings WHERE place_id NOT IN (SELECT place_id FROM gone) UNION ALL SELECT 'status', place_id, CAST(status_id AS VARCHAR) FROM place_status WHERE place_id NOT IN (SELECT place_id FROM gone)
UNION ALL SELECT 'crowd', place_id, CAST(visit_id AS VARCHAR) FROM crowd_data WHERE place_id NOT IN (SELECT place_id FROM gone) UNION ALL SELECT 'feature', place_id, feature FROM place_features WHERE place_id NOT IN (SELECT place_id FROM gone)
UNION ALL SELECT 'event', CASE WHEN associated_place_id NOT IN (SELECT place_id FROM gone) THEN associated_place_id END, CAST(festival_id AS VARCHAR) FROM events_of""", "place_table", "images", "place_sources", "ratings", "place_status", "crowd_data", "place_features", "festivals"))
def er16(spark, sf_dir):
    """Places go with their rows of six tables; events lose their link."""
    tables = stored_tables(spark, sf_dir)
    gone = tables.children["ratings"].select("place_id").unionByName(tables.places.select("place_id")).where("place_id % 10 = 0")
    t = W.remove(tables, gone)
    part = lambda df, kind, item, place="place_id": df.select(F.lit(kind).alias("kind"), F.col(place).alias("place_id"), F.col(item).cast("string").alias("item"))
    parts = [part(t.places, "place", "place_name"), part(t.sources, "source", "source_id"), part(t.images, "image", "image_url"), part(t.children["ratings"], "rating", "source_id"), part(t.children["place_status"], "status", "status_id")]
    parts += [part(t.children["crowd_data"], "crowd", "visit_id"), part(t.features, "feature", "feature"), part(t.events, "event", "festival_id", "associated_place_id")]
    return reduce(DataFrame.unionByName, parts)


@query("er17_multi_district", with_views("""SELECT item_id, arg_min(district, struct_pack(d := coalesce(pow(latitude - my, 2) + pow(longitude - mx, 2), 'inf'::DOUBLE), district)) AS district
FROM (SELECT place_id AS item_id, r.related AS district, latitude, longitude FROM places p JOIN related_districts r ON r.district = p.district)
LEFT JOIN (SELECT district, list_sort(list(latitude))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS my, list_sort(list(longitude))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS mx FROM places WHERE latitude IS NOT NULL GROUP BY district) USING (district) GROUP BY item_id""", "places", "related_districts"))
def er17(spark, sf_dir):
    df = view(spark, sf_dir, "places")
    items = df.join(view(spark, sf_dir, "related_districts"), "district").select(F.col("place_id").alias("item_id"), F.col("related").alias("district"), "latitude", "longitude")
    return E.multi_district_choice(items, nearby.median_centre(df, ["district"]))


@query("er18_combine_festivals", with_views("SELECT arg_min(festival_id, struct_pack(o := CASE WHEN district IS NULL THEN 0 ELSE 1 END, festival_id)) AS festival_id, lower(festival_name) AS name_low, district, start_date FROM festivals GROUP BY lower(festival_name), district, start_date", "festivals"))
def er18(spark, sf_dir):
    df = view(spark, sf_dir, "festivals").withColumn("name_low", F.lower("festival_name"))
    return df.groupBy("name_low", "district", "start_date").agg(F.min_by("festival_id", F.struct(F.col("district").isNotNull(), "festival_id")).alias("festival_id"))


@query("er21_deduplicate", with_views("SELECT min(place_id) AS place_id FROM (SELECT min(place_id) AS place_id, latitude, longitude FROM places GROUP BY place_name, district, latitude, longitude) WHERE latitude IS NOT NULL GROUP BY latitude, longitude UNION ALL SELECT min(place_id) FROM places WHERE latitude IS NULL GROUP BY place_name, district", "places"))
def er21(spark, sf_dir):
    df = view(spark, sf_dir, "places").select("place_id", "place_name", "district", "latitude", "longitude")
    rows = df.unionByName(df).dropDuplicates()
    once = rows.groupBy("place_name", "district", "latitude", "longitude").agg(F.min("place_id").alias("place_id"))
    located = once.where("latitude IS NOT NULL").groupBy("latitude", "longitude").agg(F.min("place_id").alias("place_id"))
    return located.select("place_id").unionByName(once.where("latitude IS NULL").select("place_id"))


@query("j10_match_cascade", with_views(f""", k AS (SELECT place_id, district, place_name, {KEY_SQL} AS key FROM places)
SELECT place_id AS target_id, (SELECT min(r.place_id) FROM places r WHERE r.district = k.district AND lower(r.place_name) = lower(k.place_name)) AS ref_id, 'exact' AS how FROM k WHERE place_id % 2 = 0
UNION ALL SELECT place_id, (SELECT min(r.place_id) FROM k r WHERE r.district = k.district AND r.key = k.key), 'cleaned' FROM k WHERE place_id % 2 = 1""", "places"))
def j10(spark, sf_dir):
    df = view(spark, sf_dir, "places")
    name = F.when(F.col("place_id") % 2 == 0, F.upper("place_name")).otherwise(F.concat(F.lit("Sri "), "place_name"))
    return E.match_cascade(df.select(F.col("place_id").alias("target_id"), "district", name.alias("place_name")), df.select(F.col("place_id").alias("ref_id"), "district", "place_name"))


@query("j11_reconcile", with_views("SELECT CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS matched, CAST(count(*) FILTER (WHERE NOT hit) AS BIGINT) AS unmatched FROM (SELECT EXISTS (SELECT 1 FROM places p WHERE lower(p.place_name) = lower(s.place_name) AND p.district = s.district) AS hit FROM source_records s)", "source_records", "places"))
def j11(spark, sf_dir):
    low = lambda df: df.withColumn("low", F.lower("place_name"))
    records, known = low(view(spark, sf_dir, "source_records")), low(view(spark, sf_dir, "places")).select("low", "district").distinct().withColumn("hit", F.lit(True))
    return records.join(known, ["low", "district"], "left").agg(F.count_if(F.col("hit").isNotNull()).alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))


@query("j13_pin_lookup", with_views("SELECT c_custkey AS user_id, coalesce(p.district, n.n_name) AS district FROM customer LEFT JOIN nation n ON n_nationkey = c_nationkey LEFT JOIN (SELECT place_id, district FROM places WHERE place_id % 2 = 0) p ON p.place_id = c_custkey", "places"))
def j13(spark, sf_dir):
    pins = view(spark, sf_dir, "places").where("place_id % 2 = 0").select(F.col("place_id").alias("c_custkey"), "district")
    nation = view(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return view(spark, sf_dir, "customer").join(nation, "c_nationkey", "left").join(pins, "c_custkey", "left").select(F.col("c_custkey").alias("user_id"), F.coalesce("district", "n_name").alias("district"))


@query("j14_image_metadata", with_views("SELECT i.place_id, i.image_url, s.s_name AS author FROM images i LEFT JOIN supplier s ON s.s_suppkey = i.source_id AND i.source_id % 2 = 0 WHERE i.is_primary AND (i.source_id % 3 <> 0 OR i.source_id % 2 = 0)", "images"))
def j14(spark, sf_dir):
    images = view(spark, sf_dir, "images").where("is_primary")
    meta = view(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("author"))
    hosted = images.where("source_id % 3 = 0").join(meta, "source_id")
    others = images.where("source_id % 3 <> 0").join(meta, "source_id", "left")
    return hosted.unionByName(others).select("place_id", "image_url", "author")


@query("st1_latest_status", with_views("""SELECT place_id, status_id, status, checked_at, epoch_ms(checked_at) + 86400000 > epoch_ms((SELECT max(checked_at) FROM place_status)) - 3600000 AS is_fresh
FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY checked_at DESC, status_id DESC) AS nth FROM place_status) WHERE nth = 1""", "place_status"))
def st1(spark, sf_dir):
    events = ST.source(spark, f"{sf_dir}/events.parquet")
    status = F.when(F.col("event_type") == "error", "Closed today").when(F.col("event_type") == "signup", "Path unsafe").otherwise("Open")
    rows = events.select(F.col("event_id").alias("status_id"), F.col("user_id").alias("place_id"), status.alias("status"), F.col("ts").alias("checked_at"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"))
    return ST.latest_status(rows, scratch_path(spark, "st1")).select("place_id", "status_id", "status", F.col("checked_at").cast("timestamp_ntz").alias("checked_at"), "is_fresh")


@query("st2_rating_rollup", """SELECT l_partkey AS place_id, CAST(count(*) AS BIGINT) AS n, round(avg(r), 6) AS rating, arg_max(review, struct_pack(l_shipdate, id)) FILTER (WHERE review IS NOT NULL) AS last_review
FROM (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), l_returnflag, strftime(l_shipdate, '%Y%m%d')) AS id, l_partkey, l_shipdate, CAST(l_quantity AS BIGINT) % 6 AS r,
  CASE WHEN l_returnflag <> 'N' THEN left(repeat(l_returnflag || CAST(l_orderkey AS VARCHAR) || '-', 100), 500) END AS review FROM lineitem)
WHERE r BETWEEN 1 AND 5 GROUP BY l_partkey""")
def st2(spark, sf_dir):
    """Ratings from order lines; a line that comes twice is one rating delivered twice."""
    lines = ST.source(spark, f"{sf_dir}/lineitem.parquet")
    identity = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), "l_returnflag", F.date_format("l_shipdate", "yyyyMMdd"))
    review = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("  "), F.repeat(F.concat("l_returnflag", F.col("l_orderkey").cast("string"), F.lit("-")), 100))).otherwise("  ")
    rows = lines.select(identity.alias("rating_id"), F.col("l_partkey").alias("place_id"), (F.col("l_quantity").cast("long") % 6).alias("rating"), review.alias("review"), F.col("l_shipdate").cast("timestamp").alias("rating_date"))
    return ST.rating_rollup(rows, scratch_path(spark, "st2")).withColumn("rating", F.round("rating", 6))


@query("st3_upsert_last_seen", with_views("SELECT place_id, source_id, last_seen FROM place_sources", "place_sources"))
def st3(spark, sf_dir):
    lines = ST.source(spark, f"{sf_dir}/lineitem.parquet")
    rows = lines.select(F.col("l_partkey").alias("place_id"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("last_seen"))
    return ST.upsert_last_seen(rows, ["place_id", "source_id"], "last_seen", scratch_path(spark, "st3"))


@query("st4_search_log", with_views("SELECT search_id, search_timestamp FROM search_points", "search_points"))
def st4(spark, sf_dir):
    events = ST.source(spark, f"{sf_dir}/events.parquet").where("event_type = 'view'")
    return ST.search_log(events.select(F.col("event_id").alias("search_id"), F.col("ts").alias("search_timestamp")), scratch_path(spark, "st4"))
