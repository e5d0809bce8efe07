"""Queries of the read layer over places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.functions.geo import WIDE_BOX, in_box
from wayfarer.operators import nearby, places as P
from wayfarer.plans.registry import query
from wayfarer.sources.tables import view, with_views

SELECT = """
rated AS (SELECT place_id, avg(rating) AS rating, CAST(sum(coalesce(rating_count, 0)) AS BIGINT) AS rating_count FROM ratings GROUP BY place_id),
pictured AS (SELECT place_id, image_url FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY is_primary DESC, image_url) AS nth FROM images) WHERE nth = 1),
base AS (SELECT p.*, coalesce(r.rating, 0) AS rating, coalesce(r.rating_count, 0) AS rating_count,
  coalesce(r.rating * r.rating_count / (r.rating_count + 10.0::DOUBLE), 0) AS weighted_rating, i.image_url
  FROM places p LEFT JOIN rated r USING (place_id) LEFT JOIN pictured i USING (place_id))
"""


def base_sql(body: str, *more: str) -> str:
    return with_views("", "places", "ratings", "images", *more).rstrip() + "," + SELECT + body


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.place_select(view(spark, sf_dir, "places"), view(spark, sf_dir, "ratings"), view(spark, sf_dir, "images"))


VIEW = SELECT.replace("base AS", "narrow AS").rstrip() + """,
full_view AS (SELECT p.place_id, p.place_name, p.district, p.city_town, p.city_town AS city, p.state, p.category_id, c.category_name, p.subcategory, p.description, p.latitude, p.longitude, p.location_precision, p.address,
  p.opening_time, p.closing_time, p.opening_days, p.avg_visit_duration, p.entry_fee, p.best_season, p.popularity_score, p.tourism_relevance, p.verified, p.source_id, p.created_at, p.updated_at,
  n.rating, n.rating_count, n.weighted_rating, n.image_url FROM place_table p LEFT JOIN categories c USING (category_id) JOIN narrow n ON n.place_id = p.place_id)
"""


def view_sql(body: str, *more: str) -> str:
    return with_views("", "places", "ratings", "images", "place_table", "categories", *more).rstrip() + "," + VIEW + body


def base_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.base_view(*(view(spark, sf_dir, t) for t in ("place_table", "categories", "ratings", "images")))


PROMINENCE = "popularity_score DESC NULLS LAST, weighted_rating DESC NULLS LAST, place_name, place_id"
SHORT = ["place_id", "place_name", "district", "popularity_score"]
SHORT_SQL = ", ".join(SHORT)


@query("pr1_place_select", view_sql(f"SELECT {', '.join(f'round({c}, 6) AS {c}' if c in ('rating', 'weighted_rating') else c for c in P.BASE_VIEW)} FROM full_view"))
def pr1(spark, sf_dir):
    return base_view(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("rating", "weighted_rating")})


@query("j1_categories", with_views("SELECT place_id, category_id, category_name FROM place_table LEFT JOIN categories USING (category_id)", "place_table", "categories"))
def j1(spark, sf_dir):
    return P.with_category(view(spark, sf_dir, "place_table"), view(spark, sf_dir, "categories")).select("place_id", "category_id", "category_name")


@query("pr3_place_label", with_views("SELECT place_id, CASE WHEN lower(district) = lower(place_name) THEN place_name ELSE concat(place_name, ' - ', district) END AS label FROM places", "places"))
def pr3(spark, sf_dir):
    same = F.lower("district") == F.lower("place_name")
    return view(spark, sf_dir, "places").select("place_id", F.when(same, F.col("place_name")).otherwise(F.concat_ws(" - ", "place_name", "district")).alias("label"))


@query("pr4_festival_when", with_views("SELECT festival_id, coalesce(strftime(start_date, '%d %b %Y'), strftime(make_date(2000, CAST(month AS INTEGER), 1), '%B'), 'Date varies') AS festival_when FROM festivals", "festivals"))
def pr4(spark, sf_dir):
    month = F.date_format(F.make_date(F.lit(2000), F.col("month").cast("int"), F.lit(1)), "MMMM")
    return view(spark, sf_dir, "festivals").select("festival_id", F.coalesce(F.date_format("start_date", "dd MMM yyyy"), month, F.lit("Date varies")).alias("festival_when"))


@query("f1_by_key", with_views("SELECT place_id, place_name FROM places WHERE place_id = 42 UNION ALL (SELECT place_id, place_name FROM places WHERE lower(place_name) = lower((SELECT place_name FROM places WHERE place_id = 7)) ORDER BY place_id LIMIT 1)", "places"))
def f1(spark, sf_dir):
    df = view(spark, sf_dir, "places").select("place_id", "place_name")
    wanted = df.where("place_id = 7").select(F.lower("place_name").alias("w"))
    by_name = df.join(F.broadcast(wanted), F.lower("place_name") == F.col("w")).drop("w").orderBy("place_id").limit(1)
    return df.where("place_id = 42").unionByName(by_name)


@query("f2_by_district", view_sql(f"SELECT 'district' AS by, {SHORT_SQL}, city, state, category_name FROM full_view WHERE lower(district) = 'nation_7' UNION ALL SELECT 'city', {SHORT_SQL}, city, state, category_name FROM full_view WHERE lower(city_town) = 'town 7' UNION ALL SELECT 'state', {SHORT_SQL}, city, state, category_name FROM full_view WHERE lower(state) = 'far state'"))
def f2(spark, sf_dir):
    df = base_view(spark, sf_dir)
    found = [P.by_text(df, c, v).withColumn("by", F.lit(k)) for k, c, v in (("district", "district", "Nation_7"), ("city", "city_town", "TOWN 7"), ("state", "state", "far State"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("by", *SHORT, "city", "state", "category_name")


TIER_SQL = "CASE WHEN lower(place_name) = q THEN 1 WHEN starts_with(lower(place_name), q) THEN 2 WHEN contains(lower(coalesce(city_town, '')), q) THEN 3 ELSE 4 END"
HOLDS_SQL = "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), q)" for c in P.SEARCHED) + ")"


@query("f3_search_places", view_sql(f"SELECT * FROM (SELECT {SHORT_SQL}, CAST({TIER_SQL} AS INTEGER) AS tier FROM full_view, (SELECT 'red' AS q) WHERE {HOLDS_SQL} ORDER BY tier, {PROMINENCE} LIMIT 20) UNION ALL SELECT * FROM (SELECT {SHORT_SQL}, CAST({TIER_SQL} AS INTEGER) AS tier FROM full_view, (SELECT 'n 3' AS q) WHERE {HOLDS_SQL} AND category_id = 3 ORDER BY tier, {PROMINENCE} LIMIT 20)"))
def f3(spark, sf_dir):
    df = base_view(spark, sf_dir)
    return P.search_view(df, " Red ", None, 20).select(*SHORT, "tier").unionByName(P.search_view(df, "n 3", 3, 20).select(*SHORT, "tier"))


@query("f3_search_many", view_sql(f""", asked AS (SELECT search_id, lower(trim(text)) AS q FROM (SELECT p_partkey AS search_id, CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' ', p_brand) WHEN 1 THEN concat(' Town ', CAST(p_partkey % 60 AS VARCHAR)) WHEN 2 THEN substr(p_name, 2, 2) ELSE concat(CAST(p_partkey AS VARCHAR), ' MAIN') END AS text FROM part WHERE p_partkey % 40 < 4)),
said AS (SELECT DISTINCT q FROM asked WHERE q <> ''),
met AS (SELECT q, place_id, {TIER_SQL} AS tier, row_number() OVER (PARTITION BY q ORDER BY {TIER_SQL}, {PROMINENCE}) AS nth FROM said, full_view WHERE {HOLDS_SQL})
SELECT search_id, place_id, CAST(tier AS INTEGER) AS tier, CAST(nth AS INTEGER) AS nth FROM asked JOIN met USING (q) WHERE nth <= 10"""))
def f3_many(spark, sf_dir):
    """Searches of every kind: whole names, towns, two letters and addresses."""
    part, k = view(spark, sf_dir, "part").where("p_partkey % 40 < 4"), F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat_ws(" ", "p_name", "p_brand")).when(k % 4 == 1, F.concat(F.lit(" Town "), k % 60)).when(k % 4 == 2, F.substring("p_name", 2, 2)).otherwise(F.concat(k.cast("string"), F.lit(" MAIN")))
    return P.search_many(base_view(spark, sf_dir), part.select(k.alias("search_id"), text.alias("text")), 10)


@query("f4_find_places", base_sql(f"SELECT {SHORT_SQL} FROM base WHERE district = 'NATION_3' AND place_name LIKE '%gear%' ORDER BY popularity_score DESC, place_name, place_id LIMIT 8"))
def f4(spark, sf_dir):
    return P.find_places(base(spark, sf_dir), 8, district="NATION_3", name_like="gear").select(*SHORT)


@query("f5_filter_interests", with_views("SELECT place_id, category_name FROM places WHERE contains(lower(coalesce(category_name, '')), 'promo') OR contains(lower(coalesce(category_name, '')), 'large')", "places"))
def f5(spark, sf_dir):
    return view(spark, sf_dir, "places").where(P.wants_any("category_name", ["Promo", "Large"])).select("place_id", "category_name")


@query("f6_district_or_all", with_views("""SELECT 'hit' AS branch, place_id FROM places WHERE lower(district) = 'nation_9' UNION ALL SELECT 'all' AS branch, place_id FROM places""", "places"))
def f6(spark, sf_dir):
    df = view(spark, sf_dir, "places").select("place_id", "district")
    hit = P.district_or_all(df, "Nation_9").select(F.lit("hit").alias("branch"), "place_id")
    return hit.unionByName(P.district_or_all(df, "Nowhere").select(F.lit("all").alias("branch"), "place_id"))


@query("f10_coordinate_filter", with_views("SELECT place_id, coalesce(latitude BETWEEN 8.0 AND 13.6 AND longitude BETWEEN 76.0 AND 80.5, FALSE) AS in_box, coalesce(latitude BETWEEN 7.9 AND 13.7 AND longitude BETWEEN 76.0 AND 80.6, FALSE) AS in_wide_box FROM places", "places"))
def f10(spark, sf_dir):
    lat, lon = F.col("latitude"), F.col("longitude")
    return view(spark, sf_dir, "places").select("place_id", in_box(lat, lon).alias("in_box"), in_box(lat, lon, WIDE_BOX).alias("in_wide_box"))


@query("f11_missing_coordinates", with_views(f"SELECT {SHORT_SQL} FROM places WHERE latitude IS NULL OR longitude IS NULL ORDER BY popularity_score DESC, place_id LIMIT 50", "places"))
def f11(spark, sf_dir):
    return view(spark, sf_dir, "places").where("latitude IS NULL OR longitude IS NULL").orderBy(F.desc("popularity_score"), "place_id").limit(50).select(*SHORT)


@query("f13_has_photo", base_sql("SELECT place_id, coalesce(regexp_matches(image_url, '^https?://'), FALSE) AS has_photo FROM base"))
def f13(spark, sf_dir):
    return base(spark, sf_dir).select("place_id", F.coalesce(F.col("image_url").rlike("^https?://"), F.lit(False)).alias("has_photo"))


def with_external_id(spark, sf_dir):
    """Places with the smallest external id that a source knows for them."""
    ids = view(spark, sf_dir, "source_records").groupBy(F.col("record_key").alias("place_id")).agg(F.min("external_id").alias("external_id"))
    return view(spark, sf_dir, "places").join(ids, "place_id", "left")


@query("f14_enrichment_worklist", with_views("SELECT place_id FROM places p WHERE place_id IN (SELECT record_key FROM source_records WHERE external_id IS NOT NULL) AND (length(description) < 30 OR NOT EXISTS (SELECT 1 FROM images i WHERE i.place_id = p.place_id))", "places", "images", "source_records"))
def f14(spark, sf_dir):
    df, shown = with_external_id(spark, sf_dir).where("external_id IS NOT NULL"), view(spark, sf_dir, "images").select("place_id").distinct().withColumn("shown", F.lit(True))
    return df.join(shown, "place_id", "left").where((F.length("description") < 30) | F.col("shown").isNull()).select("place_id")


@query("f15_name_audits", with_views("SELECT CAST(count(*) FILTER (WHERE regexp_matches(place_name, '^[0-9]')) AS BIGINT) AS numbered, CAST(count(*) FILTER (WHERE district IN ('NATION_1', 'NATION_2')) AS BIGINT) AS listed, CAST(count(*) AS BIGINT) AS n FROM places", "places"))
def f15(spark, sf_dir):
    return view(spark, sf_dir, "places").agg(F.count_if(F.col("place_name").rlike("^[0-9]")).alias("numbered"), F.count_if(F.col("district").isin("NATION_1", "NATION_2")).alias("listed"), F.count(F.lit(1)).alias("n"))


@query("f16_search_festivals", with_views("SELECT festival_id, festival_name, start_date FROM festivals WHERE contains(lower(festival_name), 'al 4') OR contains(lower(coalesce(district, '')), 'al 4') ORDER BY start_date NULLS FIRST, festival_id", "festivals"))
def f16(spark, sf_dir):
    df = view(spark, sf_dir, "festivals").where(P.any_contains(["festival_name", "district"], "al 4"))
    return df.orderBy(F.asc_nulls_first("start_date"), "festival_id").select("festival_id", "festival_name", "start_date")


@query("j4_provenance", with_views("SELECT p.place_id, s.s_name AS source_name, ps.last_seen FROM places p JOIN place_sources ps USING (place_id) JOIN supplier s ON s.s_suppkey = ps.source_id WHERE p.district = 'NATION_11'", "places", "place_sources"))
def j4(spark, sf_dir):
    df = view(spark, sf_dir, "places").where("district = 'NATION_11'").join(view(spark, sf_dir, "place_sources"), "place_id")
    sources = view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))
    return df.join(sources, "source_id").select("place_id", "source_name", "last_seen")


@query("j5_festival_places", with_views("SELECT f.festival_id, f.festival_name, CAST(count(p.place_id) AS BIGINT) AS n_places FROM festivals f LEFT JOIN places p ON p.district = f.district GROUP BY f.festival_id, f.festival_name", "festivals", "places"))
def j5(spark, sf_dir):
    per = view(spark, sf_dir, "places").groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    return view(spark, sf_dir, "festivals").join(per, "district", "left").select("festival_id", "festival_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_places"))


@query("j5_search_festivals", with_views("""SELECT f.festival_id, f.festival_name, p.place_name FROM (SELECT *, CASE WHEN festival_id % 7 = 0 THEN festival_id % 1000 END AS own FROM festivals) f LEFT JOIN places p ON p.place_id = f.own
WHERE contains(lower(f.festival_name), 'al 4') OR contains(lower(coalesce(f.district, '')), 'al 4') OR contains(lower(coalesce(p.place_name, '')), 'brand#4')""", "festivals", "places"))
def j5_search(spark, sf_dir):
    """Festivals with the name of the place they are held at, found by any of three columns."""
    held = view(spark, sf_dir, "festivals").withColumn("place_id", F.when(F.col("festival_id") % 7 == 0, F.col("festival_id") % 1000))
    df = held.join(view(spark, sf_dir, "places").select("place_id", "place_name"), "place_id", "left")
    found = P.any_contains(["festival_name", "district"], "al 4") | P.any_contains(["place_name"], "brand#4")
    return df.where(found).select("festival_id", "festival_name", "place_name")


@query("j6_festivals_for_place", with_views(""", f AS (SELECT *, CASE WHEN festival_id % 7 = 0 THEN festival_id % 1000 END AS own, coalesce(month, month(start_date), 13) AS m FROM festivals),
met AS (SELECT p.place_id, f.festival_id, CASE WHEN f.own = p.place_id THEN 0 WHEN f.district = p.district THEN 1 ELSE 2 END AS relevance, m, start_date, festival_name
FROM places p JOIN f ON f.own = p.place_id OR f.district = p.district OR f.district IS NULL)
SELECT place_id, festival_id, CAST(relevance AS INTEGER) AS relevance, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY relevance, m, start_date NULLS LAST, festival_name, festival_id) AS nth FROM met) WHERE nth <= 10""", "places", "festivals"))
def j6(spark, sf_dir):
    held = view(spark, sf_dir, "festivals").withColumn("associated_place_id", F.when(F.col("festival_id") % 7 == 0, F.col("festival_id") % 1000))
    return P.festivals_for_places(view(spark, sf_dir, "places").select("place_id", "district"), held)


@query("j9_semi_anti", with_views("SELECT CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM images i WHERE i.place_id = p.place_id)) AS BIGINT) AS with_image, CAST(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM images i WHERE i.place_id = p.place_id)) AS BIGINT) AS without_image FROM places p", "places", "images"))
def j9(spark, sf_dir):
    df, images = view(spark, sf_dir, "places"), view(spark, sf_dir, "images")
    has = df.join(images, "place_id", "left_semi").agg(F.count(F.lit(1)).alias("with_image"))
    return has.join(df.join(images, "place_id", "left_anti").agg(F.count(F.lit(1)).alias("without_image")), how="cross")


@query("a1_rating_summary", with_views("SELECT place_id, round(avg(rating), 6) AS rating, CAST(sum(rating_count) AS BIGINT) AS rating_count, round(avg(rating) * sum(rating_count) / (sum(rating_count) + 10.0::DOUBLE), 6) AS weighted_rating FROM ratings GROUP BY place_id", "ratings"))
def a1(spark, sf_dir):
    return P.rating_summary(view(spark, sf_dir, "ratings")).withColumns({c: F.round(c, 6) for c in ("rating", "weighted_rating")})


@query("a2_counts", with_views("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(latitude) AS BIGINT) AS located, CAST(count(DISTINCT district) AS BIGINT) AS districts FROM places", "places"))
def a2(spark, sf_dir):
    return view(spark, sf_dir, "places").agg(F.count(F.lit(1)).alias("n"), F.count("latitude").alias("located"), F.countDistinct("district").alias("districts"))


@query("a3_source_distribution", with_views("SELECT ps.source_id, CAST(count(*) AS BIGINT) AS n, CAST(count(p.latitude) AS BIGINT) AS located FROM place_sources ps JOIN places p USING (place_id) GROUP BY ps.source_id ORDER BY n DESC, source_id", "place_sources", "places"))
def a3(spark, sf_dir):
    df = view(spark, sf_dir, "place_sources").join(view(spark, sf_dir, "places").select("place_id", "latitude"), "place_id")
    return df.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count("latitude").alias("located")).orderBy(F.desc("n"), "source_id")


@query("a4_category_summary", base_sql("SELECT category_name, CAST(count(*) AS BIGINT) AS n_places, arg_min(place_id, ord) AS top_place, arg_min(place_id, ord) FILTER (WHERE regexp_matches(image_url, '^https?://')) AS photo_place FROM (SELECT *, row_number() OVER (ORDER BY popularity_score DESC, weighted_rating DESC, place_name, place_id) AS ord FROM base) GROUP BY category_name"))
def a4(spark, sf_dir):
    return P.category_summary(base(spark, sf_dir))


@query("a5_distinct_districts", with_views("SELECT DISTINCT district FROM places WHERE trim(district) <> '' ORDER BY district", "places"))
def a5(spark, sf_dir):
    return view(spark, sf_dir, "places").where(F.trim("district") != "").select("district").distinct().orderBy("district")


@query("a6_bounds", with_views("SELECT district, CAST(count(*) AS BIGINT) AS n_places, round(avg(latitude), 6) AS center_lat, round(avg(longitude), 6) AS center_lon, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon FROM places WHERE latitude IS NOT NULL GROUP BY district", "places"))
def a6(spark, sf_dir):
    return nearby.bounds(view(spark, sf_dir, "places"), ["district"])


@query("a7_median_centre", with_views("SELECT district, list_sort(list(latitude))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_latitude, list_sort(list(longitude))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_longitude FROM places WHERE latitude IS NOT NULL GROUP BY district", "places"))
def a7(spark, sf_dir):
    return nearby.median_centre(view(spark, sf_dir, "places"), ["district"])


@query("a8_prominence", with_views("""SELECT p.place_id, round(35 * least(greatest(coalesce(tourism_relevance, 0), 0), 1) + 25 * least(coalesce(n_sources, 0), 4) / 4.0::DOUBLE + 15 * (i.place_id IS NOT NULL)::INT + 10 * (latitude IS NOT NULL AND longitude IS NOT NULL)::INT + 5 * (x.place_id IS NOT NULL)::INT + 10 * (length(description) >= 80)::INT, 1) AS prominence
FROM places p LEFT JOIN (SELECT DISTINCT record_key AS place_id FROM source_records WHERE external_id IS NOT NULL) x USING (place_id) LEFT JOIN (SELECT place_id, count(DISTINCT source_id) AS n_sources FROM place_sources GROUP BY place_id) s USING (place_id) LEFT JOIN (SELECT DISTINCT place_id FROM images) i USING (place_id)""", "places", "place_sources", "images", "source_records"))
def a8(spark, sf_dir):
    return P.prominence(with_external_id(spark, sf_dir), view(spark, sf_dir, "place_sources"), view(spark, sf_dir, "images"))


@query("s1_prominence_order", base_sql(f"SELECT {SHORT_SQL} FROM base ORDER BY {PROMINENCE} LIMIT 25"))
def s1(spark, sf_dir):
    return P.prominent(base(spark, sf_dir), 25).select(*SHORT)


@query("s2_top_rated", base_sql("SELECT place_id, round(weighted_rating, 6) AS weighted_rating, rating_count FROM base WHERE rating_count > 0 ORDER BY base.weighted_rating DESC, base.rating DESC, rating_count DESC, popularity_score DESC, place_id LIMIT 25"))
def s2(spark, sf_dir):
    return P.top_rated(base(spark, sf_dir), 25).select("place_id", F.round("weighted_rating", 6).alias("weighted_rating"), "rating_count")


@query("s5_recommend_sort", base_sql(f"SELECT place_id, CAST(contains(lower(category_name), 'large')::INT + contains(lower(category_name), 'promo')::INT AS INTEGER) AS hits FROM base ORDER BY hits DESC, tourism_relevance DESC, {PROMINENCE} LIMIT 30"))
def s5(spark, sf_dir):
    low = F.lower("category_name")
    hits = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in ("large", "promo")), F.lit(0))
    return base(spark, sf_dir).withColumn("hits", hits.cast("int")).orderBy(F.desc("hits"), F.desc("tourism_relevance"), *P.by_prominence()).limit(30).select("place_id", "hits")


@query("s6_seeded_tie_break", with_views("SELECT place_id FROM places ORDER BY floor(popularity_score) DESC, md5('7-' || place_id), place_id LIMIT 50", "places"))
def s6(spark, sf_dir):
    """Equal popularity is ordered by a hash with a seed: alike in every run and every partitioning."""
    df = view(spark, sf_dir, "places")
    return df.orderBy(F.desc(F.floor("popularity_score")), F.md5(F.concat(F.lit("7-"), F.col("place_id").cast("string"))), "place_id").limit(50).select("place_id")


@query("s7_history", with_views("""SELECT 'search' AS listing, search_id AS id, CAST(nth AS INTEGER) AS nth FROM (SELECT search_id, row_number() OVER (ORDER BY search_timestamp DESC, search_id DESC) AS nth FROM search_points) WHERE nth <= 50
UNION ALL SELECT 'festival', festival_id, CAST(nth AS INTEGER) FROM (SELECT festival_id, row_number() OVER (ORDER BY start_date NULLS LAST, festival_name, festival_id) AS nth FROM festivals) WHERE nth <= 50
UNION ALL SELECT 'name', place_id, CAST(nth AS INTEGER) FROM (SELECT place_id, row_number() OVER (ORDER BY place_name, place_id) AS nth FROM places) WHERE nth <= 50""", "search_points", "festivals", "places"))
def s7(spark, sf_dir):
    """Three listings of fifty: searches by time, newest first, festivals by date, places by name."""
    searches = P.listing(view(spark, sf_dir, "search_points"), "search", "search_id", [F.desc("search_timestamp"), F.desc("search_id")], 50)
    festivals = P.listing(view(spark, sf_dir, "festivals"), "festival", "festival_id", [F.asc_nulls_last("start_date"), F.asc("festival_name"), F.asc("festival_id")], 50)
    return searches.unionByName(festivals).unionByName(P.listing(view(spark, sf_dir, "places"), "name", "place_id", [F.asc("place_name"), F.asc("place_id")], 50))


@query("s9_cut_with_total", base_sql(f"SELECT place_id, CAST(count(*) OVER () AS BIGINT) AS n_total FROM base WHERE region_id = 2 ORDER BY {PROMINENCE} LIMIT 60"))
def s9(spark, sf_dir):
    df = base(spark, sf_dir).where("region_id = 2")
    total = df.agg(F.count(F.lit(1)).alias("n_total"))
    return df.orderBy(*P.by_prominence()).limit(60).join(total, how="cross").select("place_id", "n_total")


@query("w1_image_order", with_views("SELECT place_id, image_url, CAST(row_number() OVER (PARTITION BY place_id ORDER BY is_primary DESC, image_url) AS INTEGER) AS image_rank FROM images QUALIFY image_rank <= 3", "images"))
def w1(spark, sf_dir):
    return P.top_per(view(spark, sf_dir, "images"), ["place_id"], [F.desc("is_primary"), F.asc("image_url")], 3, "image_rank").select("place_id", "image_url", "image_rank")


@query("w3_top_per_category", base_sql(f"SELECT category_name, place_id, CAST(place_rank AS INTEGER) AS place_rank, CAST(n AS BIGINT) AS category_size FROM (SELECT *, row_number() OVER (PARTITION BY category_name ORDER BY {PROMINENCE}) AS place_rank, count(*) OVER (PARTITION BY category_name) AS n FROM base) WHERE place_rank <= 15"))
def w3(spark, sf_dir):
    df = base(spark, sf_dir).withColumn("category_size", F.count(F.lit(1)).over(Window.partitionBy("category_name")))
    return P.top_per(df, ["category_name"], P.by_prominence(), 15).select("category_name", "place_id", "place_rank", "category_size")


@query("w4_best_photographed", base_sql(f"SELECT category_name, place_id FROM (SELECT *, row_number() OVER (PARTITION BY category_name ORDER BY {PROMINENCE}) AS nth FROM base WHERE regexp_matches(image_url, '^https?://')) WHERE nth = 1 ORDER BY category_name LIMIT 20 OFFSET 5"))
def w4(spark, sf_dir):
    shown = base(spark, sf_dir).where(F.col("image_url").rlike("^https?://"))
    return P.top_per(shown, ["category_name"], P.by_prominence(), 1).orderBy("category_name").offset(5).limit(20).select("category_name", "place_id")


@query("w8_next_occurrence", with_views("SELECT lower(festival_name) AS festival_key, festival_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(festival_name) ORDER BY coalesce(CAST(start_date AS VARCHAR), '9999'), festival_id) AS nth FROM festivals WHERE start_date IS NULL OR start_date >= DATE '1995-06-01') WHERE nth = 1", "festivals"))
def w8(spark, sf_dir):
    upcoming = view(spark, sf_dir, "festivals").where("start_date IS NULL OR start_date >= DATE '1995-06-01'").withColumn("festival_key", F.lower("festival_name"))
    return P.next_occurrences(upcoming, ["festival_key"]).select("festival_key", "festival_id")


@query("w9_keep_first", with_views("SELECT place_name, district, min(place_id) AS place_id FROM places GROUP BY place_name, district", "places"))
def w9(spark, sf_dir):
    return P.keep_first(view(spark, sf_dir, "places"), ["place_name", "district"], [F.asc("place_id")]).select("place_name", "district", "place_id")


@query("u1_dedupe_located", with_views("SELECT min(place_id) AS place_id FROM places WHERE latitude IS NOT NULL GROUP BY latitude, longitude UNION ALL SELECT place_id FROM places WHERE latitude IS NULL", "places"))
def u1(spark, sf_dir):
    df = view(spark, sf_dir, "places")
    located = P.keep_first(df.where("latitude IS NOT NULL"), ["latitude", "longitude"], [F.asc("place_id")])
    return located.unionByName(df.where("latitude IS NULL")).select("place_id")


@query("u2_source_union", with_views("SELECT CAST(1 AS INTEGER) AS source_rank, place_id, place_name, latitude FROM places WHERE region_id = 0 UNION ALL SELECT CAST(2 AS INTEGER), place_id, upper(place_name), NULL FROM places WHERE region_id = 1", "places"))
def u2(spark, sf_dir):
    df = view(spark, sf_dir, "places")
    first = df.where("region_id = 0").select(F.lit(1).alias("source_rank"), "place_id", "place_name", "latitude")
    second = df.where("region_id = 1").select(F.lit(2).alias("source_rank"), "place_id", F.upper("place_name").alias("place_name"))
    return first.unionByName(second, allowMissingColumns=True)


@query("u3_word_union", with_views("SELECT place_id, CAST(min(pos) AS INTEGER) AS word_pos FROM places, (VALUES (0, 'promo'), (1, 'small'), (2, 'large')) w(pos, word) WHERE contains(lower(category_name), word) GROUP BY place_id ORDER BY word_pos, place_id LIMIT 100", "places"))
def u3(spark, sf_dir):
    words = spark.createDataFrame([(0, "promo"), (1, "small"), (2, "large")], "pos int, word string")
    hit = view(spark, sf_dir, "places").join(F.broadcast(words), F.contains(F.lower("category_name"), F.col("word")))  # three rows
    return hit.groupBy("place_id").agg(F.min("pos").alias("word_pos")).orderBy("word_pos", "place_id").limit(100)


@query("u4_fill_up", with_views("SELECT place_id, picked FROM (SELECT place_id, category_name LIKE 'PROMO%' AS picked, row_number() OVER (ORDER BY category_name LIKE 'PROMO%' DESC, popularity_score DESC, place_id) AS nth FROM places WHERE district = 'NATION_5') WHERE nth <= 30", "places"))
def u4(spark, sf_dir):
    df = view(spark, sf_dir, "places").where("district = 'NATION_5'").withColumn("picked", F.col("category_name").like("PROMO%"))
    return df.orderBy(F.desc("picked"), F.desc("popularity_score"), "place_id").limit(30).select("place_id", "picked")
