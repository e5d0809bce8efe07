"""Queries of timelines, name parts, enrichment and the whole refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.functions import names as N, score as S, text as X
from wayfarer.functions.geo import in_box
from wayfarer.operators import messages as M, nearby, places as P, recommend as R, refresh as W, resolve as E, spelling as Y, timeline as L
from wayfarer.plans.ingest import numbered, spelt, stored_tables
from wayfarer.plans.language import PHON_SQL
from wayfarer.plans.read_layer import base, base_sql
from wayfarer.plans.registry import query
from wayfarer.operators.status import latest_status
from wayfarer.plans.travel import CONF, PAIRS_SQL, POINTS_SQL, POP, RING, SCORE, STATUS_SQL, as_of, km, points, stops
from wayfarer.session import written
from wayfarer.sources.tables import view, with_views


@query("pr2_resolve_description", with_views("SELECT place_id, CASE WHEN len(regexp_split_to_array(lower(description), '\\s+')) <= 3 THEN 'About ' || place_name ELSE description END AS description FROM places", "places"))
def pr2(spark, sf_dir):
    text = N.resolve_description(F.col("description"), F.col("place_name"), F.lit("About {name}"))
    return view(spark, sf_dir, "places").select("place_id", text.alias("description"))


def _single(sql: str) -> str:
    """Repeated letters of a key once each, in SQL."""
    for letter in " 0123456789abcdefghijklmnopqrstuvwxyz":
        sql = f"regexp_replace({sql}, '{letter}{letter}+', '{letter}', 'g')"
    return sql


SOUND_SQL = _single(f"translate(replace({_single(PHON_SQL)}, 'ch', 's'), 'gbdj', 'kpts')")


@query("sf4_sf5_sound_keys", with_views(f"SELECT source_id, record_key, sound, array_to_string(list_filter(string_split(sound, ' '), lambda w: w NOT IN ('rink', 'kear')), ' ') AS core, replace(sound, ' ', '') AS settlement FROM (SELECT source_id, record_key, {SOUND_SQL} AS sound FROM source_records)", "source_records"))
def sf45(spark, sf_dir):
    name = F.col("place_name")
    return view(spark, sf_dir, "source_records").select("source_id", "record_key", N.sound_key(name).alias("sound"), N.core_name_key(name, ["ring", "gear"]).alias("core"), N.settlement_key(name).alias("settlement"))


@query("sf6_split_locality", with_views("SELECT place_id, place_name AS head, CASE WHEN lower(category_name) = lower(district) THEN [district] ELSE [category_name, district] END AS localities FROM places", "places"))
def sf6(spark, sf_dir):
    split = N.split_locality(F.concat_ws(", ", "place_name", "district", "category_name"), F.lower("district"), F.col("district"))
    return view(spark, sf_dir, "places").select("place_id", split.alias("s")).select("place_id", "s.*")


@query("sf7_name_parts", with_views("SELECT place_id, CASE WHEN regexp_matches(place_name, ' (ring|gear) ') THEN ['metal'] WHEN regexp_matches(place_name, ' plate ') THEN ['kitchen'] ELSE [] END AS types FROM places", "places"))
def sf7(spark, sf_dir):
    parts = N.name_parts(F.col("place_name"), {"ring": "metal", "gear": "metal", "plate": "kitchen"}, ["brand"])
    return view(spark, sf_dir, "places").select("place_id", parts["types"].alias("types"))


@query("sf12_resolve_district", with_views("SELECT user_id, district AS resolved FROM users", "users"))
def sf12(spark, sf_dir):
    aliases = view(spark, sf_dir, "nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("district"))
    said = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" The "), F.lower("district"), F.lit(" district"))).when(F.col("user_id") % 3 == 1, F.upper("district")).otherwise(F.concat("district", F.lit(" Dist.")))
    return E.resolve_district(view(spark, sf_dir, "users").withColumn("said", said), "said", aliases).select("user_id", "resolved")


@query("sf21_sf22_media_titles", with_views("SELECT place_id, concat('File:', place_name, '.jpg') AS title, concat('https://commons.wikimedia.org/wiki/Special:FilePath/', replace(place_name, ' ', '_'), '.jpg') AS image, CASE WHEN place_id % 2 = 0 THEN place_name END AS article FROM places", "places"))
def sf2122(spark, sf_dir):
    url = F.concat(F.lit("https://h/wiki/Special:FilePath/"), F.replace(F.url_encode("place_name"), F.lit("+"), F.lit("%20")), F.lit(".jpg"))
    tags = F.create_map(F.lit("wikimedia_commons"), F.concat(F.lit("File:"), "place_name", F.lit(".jpg")), F.lit("wikipedia"), F.concat(F.when(F.col("place_id") % 2 == 0, "en:").otherwise("ta:"), "place_name"))
    df = view(spark, sf_dir, "places").withColumn("tags", tags)
    return df.select("place_id", X.hosted_file_title(url).alias("title"), N.element_image(F.col("tags")).alias("image"), N.english_title(F.col("tags")).alias("article"))


@query("sf24_festival_type", with_views("SELECT festival_id, CASE WHEN regexp_matches(festival_name, ' [12]$') THEN NULL WHEN regexp_matches(festival_name, ' 3$') THEN 'Cultural' ELSE 'Religious' END AS festival_type FROM festivals", "festivals"))
def sf24(spark, sf_dir):
    named = F.regexp_replace(F.regexp_replace("festival_name", " [12]$", " Republic Day"), " 3$", " Pongal")
    return view(spark, sf_dir, "festivals").select("festival_id", N.festival_type(named).alias("festival_type"))


@query("r3_match_interests", with_views("SELECT place_id, CASE WHEN category_name = 'LARGE' THEN 1.0::DOUBLE WHEN category_name = 'MEDIUM' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS interest FROM places", "places"))
def r3(spark, sf_dir):
    df = view(spark, sf_dir, "places").select("place_id", "category_name", F.array(F.lit("LARGE")).alias("preferred"))
    related = spark.createDataFrame([("LARGE", "LARGE"), ("LARGE", "MEDIUM")], "category string, related string")
    both = df.join(R.category_similarity(df, related, "place_id"), "place_id")
    return both.select("place_id", F.greatest("similarity", R.interest_score(F.col("category_name"), F.col("preferred"))).alias("interest"))


@query("r7_r8_score_with_maps", base_sql("SELECT place_id, round(100 * (0.20::DOUBLE * rating / 5 + 0.15::DOUBLE * least(greatest(pop / 100, 0), 1) + 0.20::DOUBLE * CASE WHEN place_id % 2 = 0 THEN 0.8::DOUBLE ELSE tourism_relevance END + 0.10::DOUBLE * conf), 8) AS score FROM (SELECT *, greatest(round(100 * (0.4::DOUBLE * rating / 5.0::DOUBLE + 0.3::DOUBLE * least(rating_count / 1000.0::DOUBLE, 1)), 2), popularity_score) AS pop, CASE WHEN rating_count <= 0 THEN 0.0::DOUBLE ELSE round(least(rating_count / 1000.0::DOUBLE, 1.0::DOUBLE), 4) END AS conf FROM base)"))
def r78(spark, sf_dir):
    given = view(spark, sf_dir, "places").where("place_id % 2 = 0").select("place_id", F.lit(0.8).alias("given"))
    df = base(spark, sf_dir).join(given, "place_id", "left").withColumn("interest", S.clip(F.coalesce("given", "tourism_relevance"), 0, 1))
    scored = R.score_places(df.withColumns({"distance_km": F.lit(None).cast("double"), "suitability": F.lit(1.0)}), digits=8)
    return scored.select("place_id", "score")


@query("g4_start_search", with_views(f""", {POINTS_SQL.replace("points AS (", "near AS (")},
points AS (SELECT * FROM near UNION ALL SELECT latitude + 20 AS latitude, longitude, -point_id AS point_id FROM near WHERE point_id % 3 = 0), {PAIRS_SQL},
status AS (SELECT place_id, arg_max(status, struct_pack(checked_at, status_id)) AS status FROM place_status GROUP BY place_id),
rings AS (SELECT *, CAST({RING} AS DOUBLE) AS ring FROM pairs WHERE distance_km <= 100),
cum AS (SELECT point_id, ring, sum(count(*)) OVER (PARTITION BY point_id ORDER BY ring) AS n FROM rings GROUP BY point_id, ring),
enough AS (SELECT point_id, coalesce(min(ring) FILTER (WHERE n >= 10), 100) AS radius_km FROM cum GROUP BY point_id),
far AS (SELECT point_id, place_id, distance_km, row_number() OVER (PARTITION BY point_id ORDER BY distance_km, place_id) AS nth FROM pairs WHERE point_id NOT IN (SELECT point_id FROM enough)),
found AS (SELECT point_id, place_id, distance_km, 'radius' AS how FROM rings JOIN enough USING (point_id) WHERE ring <= radius_km UNION ALL SELECT point_id, place_id, distance_km, 'nearest' FROM far WHERE nth <= 10)
SELECT point_id, place_id, round(distance_km, 6) AS distance_km, how, coalesce(status, 'Unknown') AS status FROM found LEFT JOIN status USING (place_id)""", "search_points", "places", "place_status"))
def g4(spark, sf_dir):
    """Places around every point, or the nearest where there are none within reach, with their latest status."""
    near = points(spark, sf_dir)
    far = near.where("point_id % 3 = 0").select((F.col("latitude") + 20).alias("latitude"), "longitude", (-F.col("point_id")).alias("point_id"))
    found = nearby.start_search(near.unionByName(far), view(spark, sf_dir, "places"), "point_id")
    newest = view(spark, sf_dir, "place_status").groupBy("place_id").agg(F.max_by("status", F.struct("checked_at", "status_id")).alias("status"))
    return found.join(newest, "place_id", "left").select("point_id", "place_id", F.round("distance_km", 6).alias("distance_km"), "how", F.coalesce("status", F.lit("Unknown")).alias("status"))


SEARCH_SQL = f""", {STATUS_SQL}, {POINTS_SQL.replace("points AS (", "near AS (")},
points AS (SELECT * FROM near UNION ALL SELECT latitude + 20 AS latitude, longitude, -point_id AS point_id FROM near WHERE point_id % 3 = 0), {PAIRS_SQL},
rings AS (SELECT *, CAST({RING} AS DOUBLE) AS ring FROM pairs WHERE distance_km <= 100),
cum AS (SELECT point_id, ring, sum(count(*)) OVER (PARTITION BY point_id ORDER BY ring) AS n FROM rings GROUP BY point_id, ring),
enough AS (SELECT point_id, coalesce(min(ring) FILTER (WHERE n >= 10), 100) AS radius_km FROM cum GROUP BY point_id),
far AS (SELECT point_id, place_id, distance_km, row_number() OVER (PARTITION BY point_id ORDER BY distance_km, place_id) AS nth FROM pairs WHERE point_id NOT IN (SELECT point_id FROM enough)),
found AS (SELECT point_id, place_id, distance_km, radius_km FROM rings JOIN enough USING (point_id) WHERE ring <= radius_km UNION ALL SELECT point_id, place_id, distance_km, NULL FROM far WHERE nth <= 10),
scored AS (SELECT point_id, place_id, distance_km, {SCORE.replace("suitability, 2)", "suitability, 6)")} AS score FROM (SELECT *, {POP} AS pop, {CONF} AS conf, CASE WHEN category_name = 'PROMO' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS interest FROM found JOIN base USING (place_id) JOIN stat USING (place_id)))"""


def searched(spark, sf_dir):
    near = points(spark, sf_dir)
    far = near.where("point_id % 3 = 0").select((F.col("latitude") + 20).alias("latitude"), "longitude", (-F.col("point_id")).alias("point_id"))
    rated = latest_status(base(spark, sf_dir), view(spark, sf_dir, "place_status"), as_of()).withColumn("interest", F.when(F.col("category_name") == "PROMO", 1.0).otherwise(0.0))
    return R.search_from(near.unionByName(far), rated, "point_id", digits=6)


@query("g4_search_ranked", base_sql(SEARCH_SQL + " SELECT point_id, place_id, score, CAST(row_number() OVER (PARTITION BY point_id ORDER BY score DESC, distance_km, place_id) AS INTEGER) AS nth FROM scored", "search_points", "place_status"))
def g4_ranked(spark, sf_dir):
    """What searches around every point show, by score."""
    return searched(spark, sf_dir)[0].select("point_id", "place_id", "score", "nth")


@query("g4_search_log", base_sql(SEARCH_SQL + " SELECT point_id, round(any_value(latitude), 6) AS latitude, CAST(10 AS DOUBLE) AS initial_radius, max(coalesce(radius_km, round(distance_km))) AS final_radius, CAST(count(*) AS BIGINT) AS places_found FROM found JOIN points USING (point_id) GROUP BY point_id", "search_points", "place_status"))
def g4_log(spark, sf_dir):
    """One entry for each search."""
    return searched(spark, sf_dir)[1].select("point_id", F.round("latitude", 6).alias("latitude"), "initial_radius", "final_radius", "places_found")


def days(spark, sf_dir):
    """Stops by trip and day, four a day; categories take the place of kinds."""
    kinds = F.when(F.col("category_name") == "PROMO", "temple").when(F.col("category_name") == "LARGE", "beach").when(F.col("category_name") == "SMALL", "heritage").otherwise(F.col("category_name"))
    df = stops(spark, sf_dir).withColumn("category_name", kinds)
    return df.withColumn("day", (F.floor((F.col("stop_no") - 1) / 4) + 1).cast("long"))


@query("t5_place_profile", with_views("SELECT trip_id, stop_no, CASE category_name WHEN 'PROMO' THEN 'temple' WHEN 'LARGE' THEN 'beach' WHEN 'SMALL' THEN 'heritage' END AS kind, CAST(avg_visit_duration AS DOUBLE) AS minutes, CAST(CASE category_name WHEN 'PROMO' THEN 330 WHEN 'LARGE' THEN 330 WHEN 'SMALL' THEN 540 ELSE 480 END AS DOUBLE) AS opens FROM trip_stops JOIN places USING (place_id)", "trip_stops", "places"))
def t5(spark, sf_dir):
    return L.with_profile(days(spark, sf_dir)).select("trip_id", "stop_no", "kind", "minutes", F.col("windows")[0]["o"].alias("opens"))


@query("t7_timeline")
def t7(spark, sf_dir):
    df = L.day_stops(days(spark, sf_dir), ["trip_id", "day"]).withColumn("t", L.timeline(F.col("stops")))
    return df.select("trip_id", "day", F.round("t.cost", 2).alias("cost"), "t.entries")


@query("t8_best_order")
def t8(spark, sf_dir):
    return L.best_order(L.day_stops(days(spark, sf_dir), ["trip_id", "day"]), ["trip_id", "day"])


@query("t9_never_schedulable", with_views("SELECT trip_id, stop_no FROM trip_stops JOIN places USING (place_id) WHERE CASE category_name WHEN 'PROMO' THEN greatest(330, 660) + avg_visit_duration > least(750, 780) WHEN 'LARGE' THEN 660 + avg_visit_duration > 780 WHEN 'SMALL' THEN 660 + avg_visit_duration > 780 ELSE 660 + avg_visit_duration > 780 END", "trip_stops", "places"))
def t9(spark, sf_dir):
    return L.never_schedulable(days(spark, sf_dir), 660, 780).select("trip_id", "stop_no")


@query("t11_timing_note", with_views("SELECT trip_id, stop_no, CASE category_name WHEN 'LARGE' THEN CASE WHEN stop_no * 120 + 360 >= 960 THEN 'evening breeze' ELSE 'calm morning' END WHEN 'SMALL' THEN CASE WHEN (stop_no * 120 + 360) / 60.0 BETWEEN 11 AND 15.999 THEN 'shade in the heat of the day' ELSE 'open in the daytime' END WHEN 'PROMO' THEN CASE WHEN stop_no * 120 + 360 < 720 THEN 'temple open in the morning' WHEN stop_no * 120 + 360 >= 960 THEN 'temple open in the evening' ELSE 'temple hours vary at midday' END ELSE '' END AS note FROM trip_stops JOIN places USING (place_id)", "trip_stops", "places"))
def t11(spark, sf_dir):
    df = L.with_profile(days(spark, sf_dir))
    return df.select("trip_id", "stop_no", L.timing_note(F.coalesce("kind", F.lit("none")), F.col("stop_no") * 120 + 360).alias("note"))


@query("m7_grounded_candidates", with_views("SELECT conv_id, turn, place_id, CAST(nth AS INTEGER) AS nth FROM (SELECT m.conv_id, m.turn, p.place_id, row_number() OVER (PARTITION BY m.conv_id, m.turn ORDER BY popularity_score DESC, p.place_id) AS nth FROM (SELECT conv_id, turn, concat('NATION_', conv_id % 25) AS district, CASE WHEN turn % 4 = 0 THEN 'PROMO' ELSE 'NONE' END AS category FROM messages) m JOIN places p ON p.district = m.district AND (p.category_name = m.category OR NOT EXISTS (SELECT 1 FROM places q WHERE q.district = m.district AND q.category_name = m.category))) WHERE nth <= 8", "messages", "places"))
def m7(spark, sf_dir):
    """District and category of a message; the category is dropped where the district has none of it."""
    asked = view(spark, sf_dir, "messages").select("conv_id", "turn", F.concat(F.lit("NATION_"), F.col("conv_id") % 25).alias("district"), F.when(F.col("turn") % 4 == 0, "PROMO").otherwise("NONE").alias("category"))
    places = view(spark, sf_dir, "places").select("place_id", "district", "category_name", "popularity_score")
    has = places.select("district", F.col("category_name").alias("category")).distinct().withColumn("has", F.lit(True))
    # What many ask for is looked up once: the first places meet messages, not all of the district.
    met = asked.select("district", "category").distinct().join(has, ["district", "category"], "left").join(places, "district").where(F.col("has").isNull() | (F.col("category_name") == F.col("category")))
    best = P.top_per(met, ["district", "category"], [F.desc("popularity_score"), F.asc("place_id")], 8, "nth").select("district", "category", "place_id", "nth")
    return asked.join(best, ["district", "category"]).select("conv_id", "turn", "place_id", "nth")


ASKED_SQL = """, asked AS (SELECT conv_id, turn, message || CASE conv_id % 3 WHEN 0 THEN ' in Nation_' || CAST(conv_id % 25 AS VARCHAR) ELSE '' END || CASE WHEN turn % 4 = 0 THEN ' large ones' ELSE '' END || CASE WHEN conv_id % 5 = 0 THEN ' near ' || (SELECT place_name FROM places WHERE place_id = conv_id) ELSE '' END AS message,
  CASE WHEN conv_id % 3 = 0 THEN 'NATION_' || CAST(conv_id % 25 AS VARCHAR) END AS district, CASE WHEN turn % 4 = 0 THEN 'LARGE' END AS category FROM messages),
said AS (SELECT *, (SELECT p.place_id FROM places p WHERE contains(lower(asked.message), lower(p.place_name)) ORDER BY length(p.place_name) DESC, p.place_name DESC, p.popularity_score DESC, p.place_id LIMIT 1) AS named FROM asked),
spread AS (SELECT DISTINCT district, category FROM said WHERE district IS NOT NULL OR category IS NOT NULL),
choices AS (SELECT s.district, s.category, p.place_id, row_number() OVER (PARTITION BY s.district, s.category ORDER BY popularity_score DESC, p.place_name, p.place_id) AS nth FROM spread s JOIN places p ON (s.district IS NULL OR p.district = s.district)
  AND (s.category IS NULL OR p.category_name = s.category OR (s.district IS NOT NULL AND NOT EXISTS (SELECT 1 FROM places q WHERE q.district = s.district AND q.category_name = s.category))))"""


@query("m7_grounded_answers", with_views(ASKED_SQL + """ SELECT conv_id, turn, named AS place_id, CAST(1 AS INTEGER) AS nth, 'named' AS how FROM said WHERE named IS NOT NULL AND (district IS NULL OR category IS NULL)
UNION ALL SELECT conv_id, turn, b.place_id, CAST(nth AS INTEGER), 'listed' FROM said s JOIN choices b ON b.district IS NOT DISTINCT FROM s.district AND b.category IS NOT DISTINCT FROM s.category WHERE nth <= 8 AND (named IS NULL OR (s.district IS NOT NULL AND s.category IS NOT NULL))""", "messages", "places"))
def m7_answers(spark, sf_dir):
    """Messages with a district, a kind or a place's name in their words; all three are found in the text."""
    places = view(spark, sf_dir, "places")
    k = F.col("conv_id")
    named = places.select(F.col("place_id").alias("conv_id"), F.concat(F.lit(" near "), "place_name").alias("near")).where("conv_id % 5 = 0")
    df = view(spark, sf_dir, "messages").join(named, "conv_id", "left")
    text = F.concat("message", F.when(k % 3 == 0, F.concat(F.lit(" in Nation_"), k % 25)).otherwise(""), F.when(F.col("turn") % 4 == 0, " large ones").otherwise(""), F.coalesce("near", F.lit("")))
    said = df.select("conv_id", "turn", text.alias("message"))
    districts = view(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("district"))
    kind = X.classify(F.lower("message"), [("LARGE", r"\blarge ones\b")], None)
    return M.grounded(said, places, districts, kind, ["conv_id", "turn"])


@query("m9_static_topic", with_views("SELECT conv_id, turn, CASE WHEN contains(lower(message), 'que') THEN 'greeting' WHEN contains(lower(message), 'tion') THEN 'about' END AS topic FROM messages", "messages"))
def m9(spark, sf_dir):
    low = F.lower("message")
    return view(spark, sf_dir, "messages").select("conv_id", "turn", F.when(F.contains(low, F.lit("que")), "greeting").when(F.contains(low, F.lit("tion")), "about").alias("topic"))


#: Titles are the place's name, its upper case with more behind it, or another place's name in the same district.
ARTICLES_SQL = """, articles AS (SELECT place_id, CASE place_id % 4 WHEN 0 THEN upper(place_name) || ' of old' WHEN 1 THEN 'Quite another thing ' || CAST(place_id AS VARCHAR) ELSE place_name END AS title,
  CASE WHEN place_id % 5 <> 0 THEN repeat(description || ' ', 12) END AS extract, CASE WHEN place_id % 3 <> 0 THEN latitude + 0.01 * (place_id % 4) END AS lat, longitude AS lon, CASE WHEN place_id % 7 < 5 THEN 'https://img.example/article/' || CAST(place_id AS VARCHAR) END AS article_image FROM places),
met AS (SELECT p.*, a.title, a.extract, a.article_image FROM places p JOIN articles a USING (place_id) WHERE coalesce(""" + km("p.latitude", "p.longitude", "a.lat", "a.lon") + """ <= 2, FALSE) OR place_id % 4 <> 1)"""


@query("j15_article_enrichment", with_views(ARTICLES_SQL + """ SELECT 'source' AS kind, place_id, 'https://articles.example/' || CAST(place_id AS VARCHAR) AS item FROM met
UNION ALL SELECT 'image', place_id, article_image FROM met WHERE article_image IS NOT NULL AND place_id NOT IN (SELECT place_id FROM images)
UNION ALL SELECT 'text', place_id, regexp_replace(regexp_replace(substr(extract, 1, 100), '\\s\\S*$', ''), '[,;:]+$', '') || '…' FROM met WHERE length(coalesce(description, '')) < 80 AND length(extract) >= 80""", "places", "images"))
def j15(spark, sf_dir):
    """Articles near their place, named like it, or about something else; some have no text, position or image."""
    df, k = view(spark, sf_dir, "places"), F.col("place_id")
    title = F.when(k % 4 == 0, F.concat(F.upper("place_name"), F.lit(" of old"))).when(k % 4 == 1, F.concat(F.lit("Quite another thing "), k)).otherwise(F.col("place_name"))
    articles = df.select(
        k, title.alias("title"), F.when(k % 5 != 0, F.repeat(F.concat("description", F.lit(" ")), 12)).alias("extract"), F.when(k % 3 != 0, F.col("latitude") + 0.01 * (k % 4)).alias("latitude"), "longitude",
        F.when(k % 7 < 5, F.concat(F.lit("https://img.example/article/"), k)).alias("image_url"), F.concat(F.lit("https://articles.example/"), k).alias("article_url"),
    )
    texts, images, sources = P.enrich_from_articles(df, articles, view(spark, sf_dir, "images"), 100)
    part = lambda rows, kind, item: rows.select(F.lit(kind).alias("kind"), "place_id", F.col(item).alias("item"))
    return part(sources, "source", "article_url").unionByName(part(images, "image", "image_url")).unionByName(part(texts, "text", "description"))


CATEGORY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(concat_ws(' ', place_name, category_name)), '{rule}') THEN '{name}'" for name, rule in X.CATEGORY_RULES) + " ELSE 'Cultural' END"


@query("er19_make_place", with_views(f"""SELECT place_id, place_name, district, {CATEGORY_SQL} AS category, CASE WHEN length(description) <= 40 THEN description ELSE regexp_replace(regexp_replace(substr(description, 1, 40), '\\s\\S*$', ''), '[,;:]+$', '') || '…' END AS description,
CASE WHEN latitude BETWEEN 8.0 AND 13.6 AND longitude BETWEEN 76.0 AND 80.5 THEN latitude END AS latitude, CASE WHEN latitude BETWEEN 8.0 AND 13.6 AND longitude BETWEEN 76.0 AND 80.5 THEN longitude END AS longitude
FROM places WHERE length(place_name) BETWEEN 3 AND 120 AND district IN (SELECT n_name FROM nation) AND NOT regexp_matches(lower(concat_ws(' ', place_name, category_name, description)), '{X.EDUCATION}')""", "places"))
def er19(spark, sf_dir):
    """Records with clean names, known districts and categories; junk and teaching go, positions outside the region are unknown."""
    known = view(spark, sf_dir, "nation").select(F.col("n_name").alias("district"))
    df = view(spark, sf_dir, "places").withColumn("place_name", X.clean_place_name(F.col("place_name")))
    teaching = F.lower(F.concat_ws(" ", "place_name", "category_name", "description")).rlike(X.EDUCATION)
    kept = df.where(~X.junk_name(F.col("place_name"), F.col("district")) & ~teaching).join(known, "district", "left_semi")
    inside = in_box(F.col("latitude"), F.col("longitude"))
    return kept.withColumns({c: F.when(inside, F.col(c)) for c in ("latitude", "longitude")}).select("place_id", "place_name", "district", X.classify(F.concat_ws(" ", "place_name", "category_name"), X.CATEGORY_RULES, "Cultural").alias("category"), X.truncate(F.col("description"), 40).alias("description"), "latitude", "longitude")


@query("er12_merge_rounds")
def er12(spark, sf_dir):
    """Clusters of spelling duplicates are merged into their best entry, up to three times."""
    return Y.merge_rounds(spelt(spark, sf_dir))[1]


@query("er20_refresh")
def er20(spark, sf_dir):
    """A run of the sources against stored tables that lack every third place; the report of what happened."""
    tables = stored_tables(spark, sf_dir)
    tables.places = tables.places.where("place_id % 3 <> 0")
    tables.events = tables.events.withColumn("source_id", F.col("month"))
    rows = numbered(spark, sf_dir)
    meta = rows.select("image_url").distinct().where(F.col("image_url").rlike("/[0-2]$")).select("image_url", F.concat(F.lit("by "), F.right("image_url", F.lit(1))).alias("image_author"), F.lit("CC BY").alias("image_license"))
    june = tables.events.where("month = 6").withColumn("festival_name", F.upper("festival_name"))
    _, report = W.refresh(tables, rows, view(spark, sf_dir, "related_districts"), meta, F.col("image_url").rlike("/[0-3]$"), X.junk_name(F.col("place_name"), F.col("district")), F.lit("2030-01-01").cast(tables.sources.schema["last_seen"].dataType), june)
    return spark.createDataFrame(sorted(report.items()), "metric string, n long")


@query("io9_named_points", with_views("SELECT place_id AS element_id, list_sort(list_distinct([place_name, upper(place_name), lower(place_name)])) AS names, CASE WHEN category_name = 'PROMO' THEN 'worship' ELSE 'settlement' END AS kind FROM places", "places"))
def io9(spark, sf_dir):
    tags = F.create_map(F.lit("name"), F.col("place_name"), F.lit("alt_name"), F.concat(F.upper("place_name"), F.lit("; "), F.lower("place_name")), F.lit("amenity"), F.when(F.col("category_name") == "PROMO", "place_of_worship"))
    alternatives = F.transform(F.split(F.col("tags")["alt_name"], ";"), lambda n: F.trim(n))
    names = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.col("tags")["name"]), alternatives), lambda n: n != "")))
    kind = F.when(F.col("tags")["amenity"] == "place_of_worship", "worship").otherwise("settlement")
    return view(spark, sf_dir, "places").withColumn("tags", tags).select(F.col("place_id").alias("element_id"), names.alias("names"), kind.alias("kind"))
