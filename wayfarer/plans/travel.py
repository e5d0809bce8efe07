"""Queries of geographic search, status, ranking, trips, budgets and crowds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.functions import score as S
from wayfarer.functions.geo import haversine_km, valid_coordinates
from wayfarer.operators import crowd, nearby, places as P, recommend as R, trips as T
from wayfarer.operators.status import latest_status
from wayfarer.plans.read_layer import base, base_sql
from wayfarer.plans.registry import ORACLES, query
from wayfarer.sources.tables import view, with_views

AS_OF = "2024-01-20 00:00:00"


def km(a: str, b: str, c: str, d: str) -> str:
    """Haversine distance of (a, b) and (c, d) in SQL."""
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL AND {d} IS NOT NULL THEN 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))) END)"


POINT = (10.5, 78.2)
HERE = km(f"{POINT[0]}::DOUBLE", f"{POINT[1]}::DOUBLE", "latitude", "longitude")


@query("sf1_haversine", with_views(f"SELECT place_id, round({HERE}, 6) AS distance_km FROM places", "places"))
def sf1(spark, sf_dir):
    return nearby.add_distance(view(spark, sf_dir, "places"), *POINT).select("place_id", F.round("distance_km", 6).alias("distance_km"))


@query("f7_within_radius", with_views(f"SELECT place_id FROM places WHERE {HERE} <= 60", "places"))
def f7(spark, sf_dir):
    return nearby.nearby(view(spark, sf_dir, "places"), *POINT, 60).select("place_id")


@query("g2_nearby", with_views(f"SELECT place_id, round({HERE}, 6) AS distance_km FROM places WHERE {HERE} <= 40 ORDER BY {HERE}, place_id", "places"))
def g2(spark, sf_dir):
    return nearby.nearby(view(spark, sf_dir, "places"), *POINT, 40).select("place_id", F.round("distance_km", 6).alias("distance_km"))


POINTS_SQL = "points AS (SELECT DISTINCT latitude, longitude, CAST(round(latitude * 10) * 10000 + round(longitude * 10) AS BIGINT) AS point_id FROM search_points)"


def points(spark, sf_dir):
    at = view(spark, sf_dir, "search_points").select("latitude", "longitude").distinct()
    return at.withColumn("point_id", (F.round(F.col("latitude") * 10) * 10000 + F.round(F.col("longitude") * 10)).cast("long"))


PAIRS_SQL = f"pairs AS (SELECT point_id, place_id, {km('q.latitude', 'q.longitude', 'p.latitude', 'p.longitude')} AS distance_km FROM points q, places p WHERE p.latitude IS NOT NULL)"


@query("j7_distance_join", with_views(f", {POINTS_SQL}, {PAIRS_SQL} SELECT point_id, CAST(count(*) AS BIGINT) AS n_places, round(max(distance_km), 6) AS farthest_km FROM pairs WHERE distance_km <= 25 GROUP BY point_id", "search_points", "places"))
def j7(spark, sf_dir):
    found = nearby.distance_join(points(spark, sf_dir), view(spark, sf_dir, "places"), 25, "point_id")
    return found.groupBy("point_id").agg(F.count(F.lit(1)).alias("n_places"), F.round(F.max("distance_km"), 6).alias("farthest_km"))


RING = "least(greatest(10, 10 + 10 * ceil((distance_km - 10) / 10)), 100)"


@query("g3_adaptive_nearby", with_views(f""", {POINTS_SQL}, {PAIRS_SQL},
rings AS (SELECT *, CAST({RING} AS DOUBLE) AS ring FROM pairs WHERE distance_km <= 100),
cum AS (SELECT point_id, ring, sum(count(*)) OVER (PARTITION BY point_id ORDER BY ring) AS n FROM rings GROUP BY point_id, ring),
enough AS (SELECT point_id, coalesce(min(ring) FILTER (WHERE n >= 10), 100) AS radius_km FROM cum GROUP BY point_id)
SELECT point_id, place_id, radius_km FROM rings JOIN enough USING (point_id) WHERE ring <= radius_km""", "search_points", "places"))
def g3(spark, sf_dir):
    return nearby.adaptive_nearby(points(spark, sf_dir), view(spark, sf_dir, "places"), "point_id").select("point_id", "place_id", "radius_km")


@query("s4_nearest_order", base_sql(f"SELECT place_id, round(d, 6) AS distance_km FROM (SELECT place_id, rating, CASE WHEN {HERE} <= 150 THEN {HERE} END AS d FROM base) ORDER BY d NULLS LAST, rating DESC, place_id LIMIT 500"))
def s4(spark, sf_dir):
    """The nearest first, and at equal or unknown distances the better rated; here nothing is known beyond 150 km."""
    df = nearby.add_distance(base(spark, sf_dir), *POINT).withColumn("distance_km", F.when(F.col("distance_km") <= 150, F.col("distance_km")))
    return nearby.by_distance(df).limit(500).select("place_id", F.round("distance_km", 6).alias("distance_km"))


@query("g4_nearest_fallback", with_views(f"SELECT place_id, CAST(row_number() OVER (ORDER BY d, place_id) AS INTEGER) AS nth FROM (SELECT place_id, {km('20.0::DOUBLE', '70.0::DOUBLE', 'latitude', 'longitude')} AS d FROM places WHERE latitude IS NOT NULL) ORDER BY nth LIMIT 10", "places"))
def g4(spark, sf_dir):
    far = spark.createDataFrame([(1, 20.0, 70.0)], "point_id long, latitude double, longitude double")
    found = nearby.nearest(far, view(spark, sf_dir, "places"), "point_id", 10)
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("point_id").orderBy("distance_km", "place_id")).cast("int")).select("place_id", "nth")


@query("g5_nearest_anchor", with_views(f"SELECT p.place_id, round(coalesce(min({km('a.latitude', 'a.longitude', 'p.latitude', 'p.longitude')}), 10000), 6) AS nearest_km, coalesce(max({km('a.latitude', 'a.longitude', 'p.latitude', 'p.longitude')}) <= 60, FALSE) AS all_near FROM places p, (SELECT latitude, longitude FROM places WHERE place_id IN (1, 2, 3)) a GROUP BY p.place_id", "places"))
def g5(spark, sf_dir):
    df = view(spark, sf_dir, "places").select("place_id", "latitude", "longitude")
    anchors = df.where("place_id IN (1, 2, 3)").select(F.col("latitude").alias("a"), F.col("longitude").alias("b"))
    away = haversine_km(F.col("a"), F.col("b"), F.col("latitude"), F.col("longitude"))
    return df.join(F.broadcast(anchors), how="cross").groupBy("place_id").agg(F.round(F.coalesce(F.min(away), F.lit(10000.0)), 6).alias("nearest_km"), F.coalesce(F.max(away) <= 60, F.lit(False)).alias("all_near"))  # three anchors


@query("sf17_valid_coordinates", with_views("SELECT place_id, CASE WHEN ok THEN round(a, 6) END AS latitude, CASE WHEN ok THEN round(o, 6) END AS longitude FROM (SELECT place_id, latitude + 0.4::DOUBLE AS a, longitude AS o, (latitude + 0.4::DOUBLE) BETWEEN 8.0 AND 13.6 AND longitude BETWEEN 76.0 AND 80.5 AS ok FROM places)", "places"))
def sf17(spark, sf_dir):
    at = valid_coordinates(F.col("latitude") + 0.4, F.col("longitude"))
    return view(spark, sf_dir, "places").select("place_id", at.alias("c")).select("place_id", "c.*")


@query("sf18_season", with_views("SELECT festival_id, CASE WHEN month BETWEEN 3 AND 5 THEN 'Summer' WHEN month BETWEEN 6 AND 9 THEN 'Monsoon' WHEN month IN (10, 11, 12, 1, 2) THEN 'Winter' ELSE 'Unknown' END AS season, coalesce(isodow(start_date) >= 6, FALSE) AS weekend FROM festivals", "festivals"))
def sf18(spark, sf_dir):
    return view(spark, sf_dir, "festivals").select("festival_id", S.season(F.col("month")).alias("season"), F.coalesce(F.weekday("start_date") >= 5, F.lit(False)).alias("weekend"))


@query("sf23_status_suitability", with_views("SELECT status_id, round(coalesce(CASE WHEN suitability_score IS NOT NULL THEN least(greatest(suitability_score, 0), 1) END, CASE WHEN regexp_matches(lower(status), 'closed|closure|dry|unsafe') THEN 0.2 ELSE 1.0 END), 6) AS suitability FROM place_status", "place_status"))
def sf23(spark, sf_dir):
    return view(spark, sf_dir, "place_status").select("status_id", F.round(S.status_suitability(F.col("suitability_score"), F.col("status")), 6).alias("suitability"))


STATUS_SQL = f"""newest AS (SELECT place_id, status, suitability_score, expires_at FROM place_status WHERE checked_at <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY checked_at DESC, status_id DESC) = 1),
stat AS (SELECT p.place_id, coalesce(n.status, 'Status not recently verified') AS status, coalesce(n.expires_at >= TIMESTAMP '{AS_OF}', FALSE) AS is_fresh,
  CASE WHEN n.place_id IS NULL THEN 1.0::DOUBLE ELSE coalesce(CASE WHEN suitability_score IS NOT NULL THEN least(greatest(suitability_score, 0), 1) END, CASE WHEN regexp_matches(lower(n.status), 'closed|closure|dry|unsafe') THEN 0.2 ELSE 1.0 END) END AS suitability
  FROM places p LEFT JOIN newest n USING (place_id))"""


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("j8_latest_status", with_views(f", {STATUS_SQL} SELECT place_id, status, round(suitability, 6) AS suitability, is_fresh FROM stat", "place_status", "places"))
def j8(spark, sf_dir):
    df = latest_status(view(spark, sf_dir, "places").select("place_id"), view(spark, sf_dir, "place_status"), as_of())
    return df.select("place_id", "status", F.round("suitability", 6).alias("suitability"), "is_fresh")


@query("w2_latest_per_key", with_views("SELECT place_id, arg_max(status_id, struct_pack(checked_at, status_id)) AS status_id FROM place_status GROUP BY place_id", "place_status"))
def w2(spark, sf_dir):
    return view(spark, sf_dir, "place_status").groupBy("place_id").agg(F.max_by("status_id", F.struct("checked_at", "status_id")).alias("status_id"))


CONF = "CASE WHEN rating_count <= 0 THEN 0.0::DOUBLE ELSE round(least(rating_count / 1000.0::DOUBLE, 1.0::DOUBLE), 4) END"
POP = "greatest(round(100 * (0.4::DOUBLE * least(greatest(rating / 5.0::DOUBLE, 0), 1) + 0.3::DOUBLE * least(greatest(rating_count / 1000.0::DOUBLE, 0), 1)), 2), popularity_score)"


@query("r4_popularity", base_sql(f"SELECT place_id, round({POP}, 2) AS popularity FROM base"))
def r4(spark, sf_dir):
    pop = S.popularity(F.col("rating"), F.col("rating_count"), F.lit(0.0), F.col("popularity_score"))
    return base(spark, sf_dir).select("place_id", F.round(pop, 2).alias("popularity"))


@query("r5_rating_confidence", base_sql(f"SELECT place_id, {CONF} AS confidence FROM base"))
def r5(spark, sf_dir):
    return base(spark, sf_dir).select("place_id", S.rating_confidence(F.col("rating_count")).alias("confidence"))


@query("r6_weighted_rating_bayes", base_sql(f"SELECT place_id, round(CASE WHEN rating_count < 10 THEN (rating * c + 3.5::DOUBLE * (1 - c)) * 0.9::DOUBLE ELSE rating * c + 3.5::DOUBLE * (1 - c) END, 9) AS weighted_rating_bayes FROM (SELECT *, {CONF} AS c FROM base)"))
def r6(spark, sf_dir):
    return base(spark, sf_dir).select("place_id", S.weighted_rating_bayes(F.col("rating"), F.col("rating_count"), 9).alias("weighted_rating_bayes"))


@query("r1_interest", with_views("SELECT user_id, CASE WHEN lower(trim(interest)) IN ('promo', 'large') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS interest_score FROM users", "users"))
def r1(spark, sf_dir):
    wanted = F.array(F.lit(" Promo"), F.lit("LARGE"))
    return view(spark, sf_dir, "users").select("user_id", R.interest_score(F.col("interest"), wanted).alias("interest_score"))


RELATED = [(a, b) for a, bs in {"PROMO": ["PROMO", "LARGE"], "LARGE": ["LARGE", "MEDIUM"], "SMALL": ["SMALL", "ECONOMY"]}.items() for b in bs]


@query("r2_category_similarity", with_views(f"""SELECT place_id, coalesce(arg_min(CASE WHEN w.wanted = category_name THEN 1.0 ELSE 0.6 END, pos) FILTER (WHERE r.related IS NOT NULL), 0.0)::DOUBLE AS similarity
FROM places CROSS JOIN (VALUES (0, 'OTHER'), (1, 'LARGE'), (2, 'PROMO')) w(pos, wanted) LEFT JOIN (VALUES {', '.join(str(x) for x in RELATED)}) r(category, related) ON w.wanted = r.category AND category_name = r.related GROUP BY place_id""", "places"))
def r2(spark, sf_dir):
    df = view(spark, sf_dir, "places").select("place_id", "category_name", F.array(*[F.lit(x) for x in ("OTHER", "LARGE", "PROMO")]).alias("preferred"))
    return R.category_similarity(df, spark.createDataFrame(RELATED, "category string, related string"), "place_id")


SCORE = """round(100 * (0.25::DOUBLE * (1 / (1 + distance_km / 10)) + 0.20::DOUBLE * least(greatest(rating / 5, 0), 1) + 0.15::DOUBLE * least(greatest(pop / 100, 0), 1)
 + 0.20::DOUBLE * interest + 0.10::DOUBLE * conf) * suitability, 2)"""
RANKED = f""", {STATUS_SQL}, {POINTS_SQL}, {PAIRS_SQL},
scored AS (SELECT point_id, place_id, distance_km, {SCORE} AS score FROM (
  SELECT *, {POP} AS pop, {CONF} AS conf, CASE WHEN category_name = 'PROMO' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS interest
  FROM pairs JOIN base USING (place_id) JOIN stat USING (place_id) WHERE distance_km <= 50))"""


def ranked(spark, sf_dir, n):
    """Places around each point, by recommendation score."""
    rated = latest_status(base(spark, sf_dir), view(spark, sf_dir, "place_status"), as_of())
    interest = F.when(F.col("category_name") == "PROMO", 1.0).otherwise(0.0)
    return R.recommend(points(spark, sf_dir), rated, "point_id", 50, interest, n)


@query("r9_recommend", base_sql(f"{RANKED} SELECT point_id, place_id, score, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY score DESC, distance_km, place_id) AS nth FROM scored) WHERE nth <= 10", "place_status", "search_points"))
def r9(spark, sf_dir):
    return ranked(spark, sf_dir, 10).select("point_id", "place_id", "score", "nth")


USERS_SQL = """starts AS (SELECT district, min_by(latitude, place_id) AS latitude, min_by(longitude, place_id) AS longitude FROM places WHERE latitude IS NOT NULL GROUP BY district),
wishing AS (SELECT user_id, u.district, CASE WHEN user_id % 7 <> 0 THEN interest END AS interest, CASE WHEN user_id % 3 <> 0 THEN s.latitude END AS ulat, CASE WHEN user_id % 3 <> 0 THEN s.longitude END AS ulon,
  CAST([10, 25, 50, 75, 100][user_id % 5 + 1] AS DOUBLE) AS radius_km FROM users u LEFT JOIN starts s USING (district))"""


@query("r9_recommend_users", base_sql(f""", {STATUS_SQL}, {USERS_SQL},
wishes AS (SELECT DISTINCT district AS d, interest AS i, ulat, ulon, radius_km FROM wishing),
met AS (SELECT w.*, b.*, {km('ulat', 'ulon', 'latitude', 'longitude')} AS away FROM wishes w JOIN base b ON w.ulat IS NOT NULL OR w.d = b.district WHERE w.i IS NULL OR contains(lower(b.category_name), lower(w.i))),
scored AS (SELECT *, {SCORE.replace("(1 / (1 + distance_km / 10))", "coalesce(1 / (1 + away / 10), 0)").replace("suitability, 2)", "suitability, 6)")} AS score FROM (SELECT *, {POP} AS pop, {CONF} AS conf, CASE WHEN lower(category_name) = lower(i) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS interest FROM met JOIN stat USING (place_id) WHERE ulat IS NULL OR away <= radius_km + 1e-9)),
best AS (SELECT *, row_number() OVER (PARTITION BY d, i, ulat, ulon, radius_km ORDER BY score DESC, coalesce(away, 0), place_id) AS nth FROM scored)
SELECT u.user_id, b.place_id, b.score, CAST(b.nth AS INTEGER) AS nth FROM wishing u JOIN best b ON b.d = u.district AND b.i IS NOT DISTINCT FROM u.interest AND b.ulat IS NOT DISTINCT FROM u.ulat AND b.ulon IS NOT DISTINCT FROM u.ulon AND b.radius_km = u.radius_km WHERE u.ulat IS NULL OR nth <= 10""", "place_status", "users"))
def r9_users(spark, sf_dir):
    """Users with their own interests: two thirds start at a place of their district, the others look through the district."""
    rated = latest_status(base(spark, sf_dir), view(spark, sf_dir, "place_status"), as_of())
    located = view(spark, sf_dir, "places").where("latitude IS NOT NULL")
    starts = located.groupBy("district").agg(F.min_by("latitude", "place_id").alias("latitude"), F.min_by("longitude", "place_id").alias("longitude"))
    k = F.col("user_id")
    radius = F.get(F.array(*[F.lit(float(x)) for x in (10, 25, 50, 75, 100)]), (k % 5).cast("int"))
    users = view(spark, sf_dir, "users").join(starts, "district", "left").select(k, "district", F.when(k % 7 != 0, F.col("interest")).alias("interest"), *[F.when(k % 3 != 0, F.col(c)).alias(c) for c in ("latitude", "longitude")], radius.alias("radius_km"))
    return R.recommend_users(users, rated, digits=6).select("user_id", "place_id", "score", "nth")


@query("top_rated_nearby", base_sql(f"SELECT place_id, place_name, round(distance_km, 4) AS distance_km, {SCORE} AS score FROM (SELECT *, {HERE} AS distance_km, {POP} AS pop, {CONF} AS conf, 0.0::DOUBLE AS interest, 1.0::DOUBLE AS suitability FROM base) t WHERE t.distance_km <= 60 ORDER BY score DESC, t.distance_km, place_id LIMIT 10"))
def top_rated_nearby(spark, sf_dir):
    near = nearby.add_distance(base(spark, sf_dir), *POINT).where(F.col("distance_km") <= 60)
    scored = R.score_places(near.withColumns({"interest": F.lit(0.0), "suitability": F.lit(1.0)}))
    best = scored.orderBy(F.desc("score"), "distance_km", "place_id").limit(10)
    return best.select("place_id", "place_name", F.round("distance_km", 4).alias("distance_km"), "score")


@query("r10_plan_rank", base_sql(f"SELECT place_id FROM (SELECT place_id, round(100 * weighted_rating + 0.2::DOUBLE * popularity_score + greatest(0, 20 - coalesce({HERE}, 1000)), 6) AS s FROM base) ORDER BY s DESC, place_id LIMIT 50"))
def r10(spark, sf_dir):
    df = nearby.add_distance(base(spark, sf_dir), *POINT)
    value = 100 * F.col("weighted_rating") + 0.2 * F.col("popularity_score") + F.greatest(F.lit(0.0), 20 - F.coalesce("distance_km", F.lit(1000.0)))
    return df.withColumn("s", F.round(value, 6)).orderBy(F.desc("s"), "place_id").limit(50).select("place_id")


@query("s3_rank_by", base_sql("SELECT 'rating' AS kind, place_id FROM (SELECT place_id FROM base ORDER BY rating DESC, place_id LIMIT 10) UNION ALL SELECT 'popularity', place_id FROM (SELECT place_id FROM base ORDER BY coalesce(popularity_score, 0) DESC, place_id LIMIT 10) UNION ALL SELECT 'score', place_id FROM (SELECT place_id FROM base ORDER BY tourism_relevance DESC, place_id LIMIT 10) UNION ALL SELECT 'distance', place_id FROM (SELECT place_id FROM base ORDER BY " + HERE + " NULLS LAST, rating DESC, place_id LIMIT 10)"))
def s3(spark, sf_dir):
    df = base(spark, sf_dir)
    top = lambda kind, c: df.orderBy(F.desc(F.coalesce(F.col(c), F.lit(0.0))), "place_id").limit(10).select(F.lit(kind).alias("kind"), "place_id")
    away = nearby.add_distance(df, *POINT).orderBy(F.asc_nulls_last("distance_km"), F.desc("rating"), "place_id").limit(10).select(F.lit("distance").alias("kind"), "place_id")
    return top("rating", "rating").unionByName(top("popularity", "popularity_score")).unionByName(top("score", "tourism_relevance")).unionByName(away)


def stops(spark, sf_dir):
    return T.located_stops(view(spark, sf_dir, "trip_stops"), view(spark, sf_dir, "places"))


LEGS_SQL = f"""stops AS (SELECT s.trip_id, s.stop_no, p.* FROM trip_stops s JOIN places p USING (place_id)),
legs AS (SELECT *, CASE WHEN plat IS NOT NULL AND latitude IS NOT NULL THEN {km('plat', 'plon', 'latitude', 'longitude')} END AS leg_km FROM (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM stops WINDOW w AS (PARTITION BY trip_id ORDER BY stop_no)))"""


@query("w5_legs", with_views(f", {LEGS_SQL} SELECT trip_id, stop_no, round(leg_km, 6) AS leg_km FROM legs", "trip_stops", "places"))
def w5(spark, sf_dir):
    return T.legs(stops(spark, sf_dir)).select("trip_id", "stop_no", F.round("leg_km", 6).alias("leg_km"))


@query("t1_route_distance", with_views(f", {LEGS_SQL} SELECT trip_id, round(coalesce(sum(leg_km), 0), 2) AS route_km FROM legs GROUP BY trip_id", "trip_stops", "places"))
def t1(spark, sf_dir):
    return T.route_distance(stops(spark, sf_dir))


@query("w6_schedule", with_views("SELECT trip_id, stop_no, CAST(b AS BIGINT) AS start_min, CAST(b + m AS BIGINT) AS end_min FROM (SELECT trip_id, stop_no, greatest(coalesce(avg_visit_duration, 120), 30) AS m, 540 + coalesce(sum(greatest(coalesce(avg_visit_duration, 120), 30) + 30) OVER (PARTITION BY trip_id ORDER BY stop_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM trip_stops JOIN places USING (place_id))", "trip_stops", "places"))
def w6(spark, sf_dir):
    return T.schedule(stops(spark, sf_dir)).select("trip_id", "stop_no", "start_min", "end_min")


@query("t2_nearest_neighbour_route", with_views(f"""SELECT trip_id, visit_no, stop_no, place_id FROM (
WITH RECURSIVE s AS (SELECT trip_id, stop_no, place_id, latitude, longitude FROM trip_stops JOIN places USING (place_id)),
k AS (SELECT * FROM s WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
walk AS (
  SELECT trip_id, 1::BIGINT AS visit_no, stop_no, place_id, latitude, longitude, [stop_no] AS done FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY stop_no) AS nth FROM k) WHERE nth = 1
  UNION ALL
  SELECT trip_id, visit_no, stop_no, place_id, latitude, longitude, done FROM (
    SELECT w.trip_id, w.visit_no + 1 AS visit_no, k.stop_no, k.place_id, k.latitude, k.longitude, list_append(w.done, k.stop_no) AS done,
      row_number() OVER (PARTITION BY w.trip_id ORDER BY {km('w.latitude', 'w.longitude', 'k.latitude', 'k.longitude')}, k.stop_no) AS nth
    FROM walk w JOIN k ON k.trip_id = w.trip_id AND NOT list_contains(w.done, k.stop_no)) WHERE nth = 1)
SELECT trip_id, visit_no, stop_no, place_id FROM walk UNION ALL
SELECT s.trip_id, coalesce(c.n, 0) + row_number() OVER (PARTITION BY s.trip_id ORDER BY s.stop_no) AS visit_no, s.stop_no, s.place_id
FROM s LEFT JOIN (SELECT trip_id, count(*) AS n FROM k GROUP BY trip_id) c ON c.trip_id = s.trip_id WHERE s.latitude IS NULL OR s.longitude IS NULL)""", "trip_stops", "places"))
def t2(spark, sf_dir):
    return T.nearest_neighbour_route(stops(spark, sf_dir))


@query("t3_pack_days", with_views("""SELECT trip_id, stop_no, place_id, day, start_min, end_min FROM (
WITH RECURSIVE s AS (SELECT trip_id, stop_no, place_id, days, greatest(coalesce(avg_visit_duration, 120), 30) AS m FROM trip_stops JOIN places USING (place_id) JOIN trips USING (trip_id)),
fold AS (
  SELECT trip_id, stop_no, place_id, days, 540 + m > 1020 AS stuck, 1::BIGINT AS d, 540::BIGINT AS a, 540 + m AS z FROM s WHERE stop_no = 1
  UNION ALL
  SELECT s.trip_id, s.stop_no, s.place_id, s.days, f.stuck OR 540 + s.m > 1020 OR (CASE WHEN f.z + 30 + s.m > 1020 THEN f.d + 1 ELSE f.d END) > s.days,
         CASE WHEN f.z + 30 + s.m > 1020 THEN f.d + 1 ELSE f.d END, CASE WHEN f.z + 30 + s.m > 1020 THEN 540 ELSE f.z + 30 END, CASE WHEN f.z + 30 + s.m > 1020 THEN 540 ELSE f.z + 30 END + s.m
  FROM fold f JOIN s ON s.trip_id = f.trip_id AND s.stop_no = f.stop_no + 1)
SELECT trip_id, stop_no, place_id, CASE WHEN NOT stuck THEN d END AS day, CASE WHEN NOT stuck THEN CAST(a AS BIGINT) END AS start_min, CASE WHEN NOT stuck THEN CAST(z AS BIGINT) END AS end_min FROM fold)""", "trip_stops", "places", "trips"))
def t3(spark, sf_dir):
    days = view(spark, sf_dir, "trips").select("trip_id", "days")
    return T.pack_days(stops(spark, sf_dir).join(days, "trip_id"))


@query("t4_day_schedule", with_views("SELECT trip_id, day, stop_no, CAST(540 + coalesce(sum(m + 30) OVER (PARTITION BY trip_id, day ORDER BY stop_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_min FROM (SELECT trip_id, stop_no, CAST((stop_no - 1) // 3 + 1 AS BIGINT) AS day, greatest(coalesce(avg_visit_duration, 120), 30) AS m FROM trip_stops JOIN places USING (place_id))", "trip_stops", "places"))
def t4(spark, sf_dir):
    daily = stops(spark, sf_dir).withColumn("day", (F.floor((F.col("stop_no") - 1) / 3) + 1).cast("long"))
    keyed = daily.withColumn("trip", F.col("trip_id")).withColumn("trip_id", F.struct("trip_id", "day"))
    return T.schedule(keyed).select(F.col("trip").alias("trip_id"), "day", "stop_no", "start_min")


@query("t6_drive_leg", with_views(f", {LEGS_SQL} SELECT trip_id, stop_no, CAST(CASE WHEN leg_km IS NULL THEN 30 WHEN leg_km * 1.3::DOUBLE < 0.3 THEN 0 ELSE round_even((leg_km * 1.3::DOUBLE / 40.0::DOUBLE * 60.0::DOUBLE + 10.0::DOUBLE) / 5.0::DOUBLE, 0) * 5 END AS DOUBLE) AS drive_min FROM legs", "trip_stops", "places"))
def t6(spark, sf_dir):
    return T.legs(stops(spark, sf_dir)).select("trip_id", "stop_no", S.drive_minutes(F.col("leg_km")).alias("drive_min"))


@query("t10_select_for_trip", with_views(f""", starts AS (SELECT trip_id, latitude AS y, longitude AS x FROM (SELECT trip_id, place_id FROM trip_stops WHERE stop_no = 1) JOIN places USING (place_id) WHERE latitude IS NOT NULL),
asked AS (SELECT trip_id, y, x, 40 + 25 * (days - 1) AS reach, CAST(greatest(2, round_even(days * (5 + trip_id % 4) / 2.0::DOUBLE, 0)) + 2 AS INTEGER) AS wanted FROM starts JOIN trips USING (trip_id)),
met AS (SELECT *, {km('y', 'x', 'latitude', 'longitude')} AS away FROM (SELECT DISTINCT y, x FROM asked), places WHERE latitude IS NOT NULL),
scored AS (SELECT trip_id, wanted, place_id, category_name, popularity_score - 0.5::DOUBLE * away AS score FROM asked JOIN met USING (y, x) WHERE away <= reach),
kinds AS (SELECT *, row_number() OVER (PARTITION BY trip_id, category_name ORDER BY score DESC, place_id) > greatest(2, (wanted + 1) // 2) AS over FROM scored),
picked AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY over, score DESC, place_id) AS pick FROM kinds)
SELECT trip_id, place_id, round(score, 6) AS score, CAST(pick AS INTEGER) AS pick FROM picked WHERE pick <= wanted""", "trips", "trip_stops", "places"))
def t10(spark, sf_dir):
    """Places for each trip around its first stop."""
    first = stops(spark, sf_dir).where("stop_no = 1").select("trip_id", "latitude", "longitude")
    trips = view(spark, sf_dir, "trips").join(first, "trip_id").select("trip_id", "latitude", "longitude", "days", (5 + F.col("trip_id") % 4).cast("double").alias("hours"))
    return T.select_for_trip(trips, view(spark, sf_dir, "places")).withColumn("score", F.round("score", 6))


@query("t12_dedupe_stops", with_views("SELECT trip_id, min(stop_no) AS stop_no, place_id FROM trip_stops GROUP BY trip_id, place_id", "trip_stops"))
def t12(spark, sf_dir):
    return P.keep_first(view(spark, sf_dir, "trip_stops"), ["trip_id", "place_id"], [F.asc("stop_no")]).select("trip_id", "stop_no", "place_id")


@query("t13_day_compactness", with_views(f"""SELECT a.trip_id, round(max({km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}), 6) AS span_km
FROM (SELECT s.trip_id, s.stop_no, p.latitude, p.longitude FROM trip_stops s JOIN places p USING (place_id) WHERE s.stop_no <= 3 AND latitude IS NOT NULL) a
JOIN (SELECT s.trip_id, s.stop_no, p.latitude, p.longitude FROM trip_stops s JOIN places p USING (place_id) WHERE s.stop_no <= 3 AND latitude IS NOT NULL) b
ON a.trip_id = b.trip_id AND a.stop_no < b.stop_no GROUP BY a.trip_id""", "trip_stops", "places"))
def t13(spark, sf_dir):
    """The first day of each trip alone, as its SQL says; ``t13_day_spans`` has every day."""
    day = stops(spark, sf_dir).where("stop_no <= 3 AND latitude IS NOT NULL")
    a = day.select("trip_id", F.col("stop_no").alias("s1"), F.col("latitude").alias("y1"), F.col("longitude").alias("x1"))
    b = day.select("trip_id", F.col("stop_no").alias("s2"), F.col("latitude").alias("y2"), F.col("longitude").alias("x2"))
    span = F.max(haversine_km(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")))
    return a.join(b, "trip_id").where("s1 < s2").groupBy("trip_id").agg(F.round(span, 6).alias("span_km"))


def day_spans_sql() -> str:
    located = "SELECT trip_id, stop_no, CAST((stop_no - 1) // 3 + 1 AS BIGINT) AS day, latitude, longitude FROM trip_stops JOIN places USING (place_id) WHERE latitude IS NOT NULL"
    span = f"max({km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')})"
    return with_views(f"SELECT a.trip_id, a.day, round({span}, 6) AS span_km, {span} <= 60 AS compact FROM ({located}) a JOIN ({located}) b ON a.trip_id = b.trip_id AND a.day = b.day AND a.stop_no < b.stop_no GROUP BY a.trip_id, a.day", "trip_stops", "places")


@query("t13_day_spans", day_spans_sql())
def t13_days(spark, sf_dir):
    """The longest distance between two stops of each day of each trip; days are those of ``t4_day_schedule``."""
    return T.day_spans(stops(spark, sf_dir)).withColumn("span_km", F.round("span_km", 6))


RATE = lambda k: f"CASE budget_level WHEN 'budget' THEN {S.RATES[k]['budget']} WHEN 'premium' THEN {S.RATES[k]['premium']} ELSE {S.RATES[k]['standard']} END::DOUBLE"


@query("b6_total_budget", with_views(f""", {LEGS_SQL}, route AS (SELECT trip_id, round(coalesce(sum(leg_km), 0), 2) AS route_km, sum(greatest(coalesce(entry_fee, 0), 0)) AS fees FROM legs GROUP BY trip_id),
parts AS (SELECT trip_id, round(coalesce(route_km, 0) * ({RATE('transport')}), 2) AS transport, travelers * days * ({RATE('food')}) AS food, travelers * (days - 1) * ({RATE('accommodation')}) AS accommodation,
  round(coalesce(fees, 0) * travelers, 2) AS entry_fees, days * ({RATE('misc')}) AS misc FROM trips LEFT JOIN route USING (trip_id))
SELECT *, round(transport + food + accommodation + entry_fees + misc, 2) AS total FROM parts""", "trips", "trip_stops", "places"))
def b6(spark, sf_dir):
    return T.budgets(view(spark, sf_dir, "trips"), stops(spark, sf_dir))


@query("b7_cost_rules", with_views(f"SELECT trip_id, {RATE('transport')} AS per_km, {RATE('food')} + {RATE('accommodation')} + {RATE('misc')} AS per_day FROM trips", "trips"))
def b7(spark, sf_dir):
    level = F.col("budget_level")
    return view(spark, sf_dir, "trips").select("trip_id", S.rate("transport", level).alias("per_km"), (S.rate("food", level) + S.rate("accommodation", level) + S.rate("misc", level)).alias("per_day"))


RUPEE = 0.012  # dollars


@query("a10_budget_shares", f"SELECT trip_id, kind, round(100 * cost / CASE WHEN total <= 0 THEN 1 ELSE total END, 2) AS share, round(cost * {RUPEE}::DOUBLE, 4) AS amount FROM ({ORACLES['b6_total_budget']}) UNPIVOT (cost FOR kind IN (transport, food, accommodation, entry_fees, misc))")
def a10(spark, sf_dir):
    """Share of each kind of cost, and its amount in another currency."""
    kinds = ["transport", "food", "accommodation", "entry_fees", "misc"]
    long = T.budgets(view(spark, sf_dir, "trips"), stops(spark, sf_dir)).unpivot(["trip_id", "total"], kinds, "kind", "cost")
    share = F.round(100 * F.col("cost") / F.when(F.col("total") <= 0, 1.0).otherwise(F.col("total")), 2)
    return long.select("trip_id", "kind", share.alias("share"), F.round(F.col("cost") * RUPEE, 4).alias("amount"))


@query("a9_day_summary", with_views(f"""SELECT trip_id, day, CAST(count(*) AS BIGINT) AS n_stops, CASE WHEN count(*) <= 2 THEN 'Relaxed' WHEN count(*) <= 4 THEN 'Balanced' ELSE 'Packed' END AS pace, round(coalesce(sum(leg_km), 0), 4) AS km, min(around) AS around FROM (
SELECT *, {km('lag(latitude) OVER w', 'lag(longitude) OVER w', 'latitude', 'longitude')} AS leg_km FROM (SELECT trip_id, stop_no, CAST((stop_no - 1) // 3 + 1 AS BIGINT) AS day, district, latitude, longitude FROM trip_stops JOIN places USING (place_id)) WINDOW w AS (PARTITION BY trip_id, day ORDER BY stop_no))
LEFT JOIN (SELECT trip_id, day, string_agg(district, ' & ' ORDER BY first_stop) AS around FROM (SELECT trip_id, day, district, first_stop, row_number() OVER (PARTITION BY trip_id, day ORDER BY first_stop) AS nth FROM (SELECT trip_id, CAST((stop_no - 1) // 3 + 1 AS BIGINT) AS day, district, min(stop_no) AS first_stop FROM trip_stops JOIN places USING (place_id) GROUP BY ALL)) WHERE nth <= 2 GROUP BY trip_id, day) USING (trip_id, day) GROUP BY trip_id, day""", "trip_stops", "places"))
def a9(spark, sf_dir):
    df = view(spark, sf_dir, "trip_stops").join(view(spark, sf_dir, "places").select("place_id", "district", "latitude", "longitude"), "place_id")
    return T.day_summary(df)


@query("c1_classify_crowd", with_views("SELECT place_id, CASE WHEN x IS NULL OR x < 0 OR x > 1 THEN 'Unknown' WHEN x <= 0.33::DOUBLE THEN 'Low' WHEN x <= 0.66::DOUBLE THEN 'Medium' ELSE 'High' END AS crowd, CASE WHEN n < 0 THEN 'Unknown' WHEN n <= 100 THEN 'Low' WHEN n <= 400 THEN 'Medium' ELSE 'High' END AS by_count FROM (SELECT place_id, popularity_score / 90 AS x, place_id % 600 - 20 AS n FROM places)", "places"))
def c1(spark, sf_dir):
    return view(spark, sf_dir, "places").select("place_id", S.classify_crowd(F.col("popularity_score") / 90).alias("crowd"), S.classify_count(F.col("place_id") % 600 - 20, F.lit(100), F.lit(400)).alias("by_count"))


@query("c2_estimate_crowd", with_views("""SELECT p.place_id, d.day, round(least(1, greatest(0, 0.15::DOUBLE + CASE WHEN isodow(d.day) >= 6 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN month(d.day) IN (4, 5, 12) THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN EXISTS (SELECT 1 FROM festivals f WHERE f.start_date = d.day AND (f.district = p.district OR f.district IS NULL)) THEN 0.25::DOUBLE
         WHEN EXISTS (SELECT 1 FROM festivals f WHERE f.month = month(d.day) AND (f.district = p.district OR f.district IS NULL)) THEN 0.10::DOUBLE ELSE 0 END
  + CASE category_name WHEN 'PROMO' THEN 0.15::DOUBLE WHEN 'LARGE' THEN 0.10::DOUBLE ELSE 0 END)), 4) AS crowd_level
FROM places p, (VALUES (DATE '1995-04-15'), (DATE '1995-12-06'), (DATE '1996-07-02')) d(day)""", "places", "festivals"))
def c2(spark, sf_dir):
    days = spark.sql("SELECT explode(array(DATE '1995-04-15', DATE '1995-12-06', DATE '1996-07-02')) AS day")
    found = crowd.estimate(view(spark, sf_dir, "places"), days, view(spark, sf_dir, "festivals"), {"PROMO": 0.15, "LARGE": 0.10}, [4, 5, 12])
    return found.select("place_id", "day", F.round("crowd_level", 4).alias("crowd_level"))


@query("c3_crowd_features", with_views("SELECT status_id, CAST(month(checked_at) AS INTEGER) AS month, CAST(isodow(checked_at) - 1 AS INTEGER) AS day_of_week, isodow(checked_at) >= 6 AS is_weekend, round(coalesce(suitability_score, 0), 6) AS signal FROM place_status", "place_status"))
def c3(spark, sf_dir):
    return crowd.features(view(spark, sf_dir, "place_status")).select("status_id", "month", "day_of_week", "is_weekend", F.round("signal", 6).alias("signal"))


@query("c6_evaluate", with_views("""SELECT label, CAST(sum((label = truth)::INT) AS BIGINT) AS support, round(coalesce(sum((label = truth AND label = guess)::INT) / nullif(sum((label = guess)::INT), 0), 0), 4) AS precision, round(coalesce(sum((label = truth AND label = guess)::INT) / nullif(sum((label = truth)::INT), 0), 0), 4) AS recall
FROM (SELECT CASE WHEN popularity_score < 33 THEN 'Low' WHEN popularity_score < 66 THEN 'Medium' ELSE 'High' END AS truth, CASE WHEN tourism_relevance < 0.33 THEN 'Low' WHEN tourism_relevance < 0.66 THEN 'Medium' ELSE 'High' END AS guess FROM places), (VALUES ('Low'), ('Medium'), ('High')) l(label) GROUP BY label""", "places"))
def c6(spark, sf_dir):
    cut = lambda c, a, b: F.when(c < a, "Low").when(c < b, "Medium").otherwise("High")
    guesses = view(spark, sf_dir, "places").select(cut(F.col("popularity_score"), 33, 66).alias("truth"), cut(F.col("tourism_relevance"), 0.33, 0.66).alias("guess"))
    return crowd.evaluate(guesses)


@query("c4_c5_crowd_model")
def c45(spark, sf_dir):
    """A forest learns the class of each row of the status log; the rows held out are predicted with all probabilities.

    The class follows from the day of the week and the month with some rows off, as a status log would have it, and not from
    the signal whose presence is a feature.
    """
    busy = (F.col("day_of_week") >= 5).cast("double") * 0.5 + F.when(F.col("month").isin(1, 5, 12), 0.4).otherwise(0.1) + F.when(F.pmod(F.xxhash64("status_id"), F.lit(10)) == 0, 0.3).otherwise(0.0)
    df = crowd.features(view(spark, sf_dir, "place_status")).withColumn("label", S.classify_crowd(busy))
    train, test = crowd.split(df, "status_id", "label")
    return crowd.predict(crowd.train(train), test).select("status_id", "label", "prediction_label", "confidence", "probabilities")


@query("c6_model_report")
def c6_report(spark, sf_dir):
    """Accuracy, F1 and the counts of (truth, guess) of the crowd model on the rows held out."""
    got = c45(spark, sf_dir).select(F.col("label").alias("truth"), F.col("prediction_label").alias("guess"))
    return crowd.report(got)


@query("r11_recommendation_model")
def r11(spark, sf_dir):
    """A forest regression of the stored popularity on ratings: predictions for places held out, with MAE and R2."""
    df = base(spark, sf_dir).select("place_id", "rating", F.col("rating_count").cast("double").alias("rating_count"), "weighted_rating", "tourism_relevance", F.col("popularity_score").alias("target"))
    train, test = crowd.split(df, "place_id")
    guessed = crowd.regress(train, test, ["rating", "rating_count", "weighted_rating", "tourism_relevance"], "target")
    fit = crowd.regression_report(guessed, "target")
    return guessed.join(F.broadcast(fit), how="cross").select("place_id", F.round("prediction", 4).alias("prediction"), "mae", "r2")  # one row
