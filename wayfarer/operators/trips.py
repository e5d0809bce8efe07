"""Batch computations over many trips: legs, schedules, packing into days, greedy routes and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.functions.geo import haversine_km
from wayfarer.functions.score import accommodation_cost, food_cost, misc_cost, rate, transport_cost
from wayfarer.operators.nearby import distance_join
from wayfarer.session import written


def located_stops(stops: DataFrame, places: DataFrame) -> DataFrame:
    return stops.join(places.select("place_id", "place_name", "category_name", "latitude", "longitude", "entry_fee", "avg_visit_duration", "popularity_score"), "place_id")


def legs(stops: DataFrame) -> DataFrame:
    """Distance from the previous stop of the trip; null where either position is unknown."""
    w = Window.partitionBy("trip_id").orderBy("stop_no")
    prev_lat, prev_lon = F.lag("latitude").over(w), F.lag("longitude").over(w)
    return stops.withColumn("leg_km", haversine_km(prev_lat, prev_lon, F.col("latitude"), F.col("longitude")))


#: A day is compact if no two of its stops lie farther apart.
COMPACT_KM = 60.0


def day_spans(stops: DataFrame, per_day: int = 3) -> DataFrame:
    """``trip_id, day, span_km, compact``: the longest distance between two located stops of a day, over all days of a trip.

    Days hold ``per_day`` stops in turn, so a day has few pairs; a day without two located stops has no row.
    """
    day = (F.floor((F.col("stop_no") - 1) / per_day) + 1).cast("long")
    side = lambda n: stops.where("latitude IS NOT NULL").select("trip_id", day.alias("day"), F.col("stop_no").alias(f"s{n}"), F.col("latitude").alias(f"y{n}"), F.col("longitude").alias(f"x{n}"))
    pairs = side(1).join(side(2), ["trip_id", "day"]).where("s1 < s2")
    spans = pairs.groupBy("trip_id", "day").agg(F.max(haversine_km(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))).alias("span_km"))
    return spans.withColumn("compact", F.col("span_km") <= COMPACT_KM)


def day_summary(stops: DataFrame, per_day: int = 3) -> DataFrame:
    """``trip_id, day, n_stops, pace, km, around``: how full each day is, its way between stops and its first two districts."""
    daily = stops.withColumn("day", (F.floor((F.col("stop_no") - 1) / per_day) + 1).cast("long"))
    w = Window.partitionBy("trip_id", "day").orderBy("stop_no")
    daily = daily.withColumn("leg_km", haversine_km(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude")))
    n, seen = F.count(F.lit(1)), F.array_sort(F.collect_list(F.struct("stop_no", "district")))  # a day has few stops
    districts = F.array_distinct(F.filter(F.transform(seen, lambda s: F.trim(s["district"])), lambda d: d.isNotNull() & (d != "")))
    pace = F.when(n <= 2, "Relaxed").when(n <= 4, "Balanced").otherwise("Packed")
    return daily.groupBy("trip_id", "day").agg(
        n.alias("n_stops"), pace.alias("pace"), F.round(F.coalesce(F.sum("leg_km"), F.lit(0.0)), 4).alias("km"), F.array_join(F.slice(districts, 1, 2), " & ").alias("around")
    )


def route_distance(stops: DataFrame) -> DataFrame:
    """Sum of the known legs of each trip."""
    return legs(stops).groupBy("trip_id").agg(F.round(F.coalesce(F.sum("leg_km"), F.lit(0.0)), 2).alias("route_km"))


def schedule(stops: DataFrame, start: int = 540, pause: int = 30) -> DataFrame:
    """Start and end minute of each stop: the stops before it take their time and a pause."""
    minutes = F.greatest(F.coalesce("avg_visit_duration", F.lit(120)), F.lit(30))
    before = Window.partitionBy("trip_id").orderBy("stop_no").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.lit(start) + F.coalesce(F.sum(minutes + pause).over(before), F.lit(0))
    return stops.withColumn("start_min", begins.cast("long")).withColumn("end_min", (begins + minutes).cast("long"))


def entry_fees(stops: DataFrame, trips: DataFrame) -> DataFrame:
    """Fees of all stops for all travellers; missing and negative fees cost nothing."""
    summed = stops.groupBy("trip_id").agg(F.sum(F.greatest(F.coalesce("entry_fee", F.lit(0.0)), F.lit(0.0))).alias("fees"))
    return trips.join(summed, "trip_id", "left").select("trip_id", F.round(F.coalesce("fees", F.lit(0.0)) * F.greatest("travelers", F.lit(1)), 2).alias("entry_fees"))


def budgets(trips: DataFrame, stops: DataFrame) -> DataFrame:
    """Costs of each trip by kind and in total."""
    level, n, days = F.col("budget_level"), F.col("travelers"), F.col("days")
    joined = trips.join(route_distance(stops), "trip_id", "left").join(entry_fees(stops, trips), "trip_id", "left")
    priced = joined.select(
        "trip_id",
        transport_cost(F.coalesce("route_km", F.lit(0.0)), rate("transport", level)).alias("transport"),
        food_cost(n, days, rate("food", level)).alias("food"),
        accommodation_cost(n, days - 1, rate("accommodation", level)).alias("accommodation"),
        F.coalesce("entry_fees", F.lit(0.0)).alias("entry_fees"),
        misc_cost(days, rate("misc", level)).alias("misc"),
    )
    total = F.col("transport") + F.col("food") + F.col("accommodation") + F.col("entry_fees") + F.col("misc")
    return priced.withColumn("total", F.round(total, 2))


def pack_days(stops: DataFrame, start: int = 540, finish: int = 1020, pause: int = 30) -> DataFrame:
    """``trip_id, stop_no, place_id, day, start_min, end_min``: days are filled in order, each until the next stop would
    end after ``finish``.

    A fold over the trip's ordered stops. ``days`` bounds the days of a trip; what is left after them has no day, and so
    have a stop that is too long for any day and all that come after it.
    """
    minutes = F.greatest(F.coalesce("avg_visit_duration", F.lit(120)), F.lit(30)).cast("long")
    days = F.greatest(F.coalesce(F.max("days"), F.lit(1)), F.lit(1)).cast("long").alias("days")
    listed = stops.groupBy("trip_id").agg(days, F.sort_array(F.collect_list(F.struct("stop_no", "place_id", minutes.alias("minutes")))).alias("stops"))
    # A day beyond the last one marks that nothing more is placed.
    state = "struct<day: bigint, clock: bigint, out: array<struct<stop_no: bigint, place_id: bigint, day: bigint, start_min: bigint, end_min: bigint>>>"
    day = f"CASE WHEN s.day > days OR {start} + x.minutes > {finish} THEN days + 1 WHEN s.clock + x.minutes > {finish} THEN s.day + 1 ELSE s.day END"
    begin = f"IF(s.clock + x.minutes > {finish}, {start}L, s.clock)"
    entry = lambda d, a: f"named_struct('stop_no', x.stop_no, 'place_id', x.place_id, 'day', {d}, 'start_min', {a}, 'end_min', {a} + x.minutes)"
    none = "CAST(NULL AS BIGINT)"
    text = f"""aggregate(stops, CAST(named_struct('day', 1, 'clock', {start}, 'out', array()) AS {state}),
      (s, x) -> IF({day} > days,
        named_struct('day', days + 1, 'clock', {start}L, 'out', concat(s.out, array({entry(none, none)}))),
        named_struct('day', {day}, 'clock', {begin} + x.minutes + {pause}L, 'out', concat(s.out, array({entry(day, begin)})))))"""
    return listed.select("trip_id", F.inline(F.expr(text)["out"]))


def nearest_neighbour_route(stops: DataFrame) -> DataFrame:
    """Visit order of each trip: always the nearest stop left, from the first one; unlocated stops last, in order."""
    listed = stops.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("stop_no", "place_id", "latitude", "longitude"))).alias("stops"))
    listed = listed.select("trip_id", F.filter("stops", lambda s: s["latitude"].isNotNull() & s["longitude"].isNotNull()).alias("known"), F.filter("stops", lambda s: s["latitude"].isNull() | s["longitude"].isNull()).alias("rest"))
    kind = "array<struct<stop_no: bigint, place_id: bigint, latitude: double, longitude: double>>"
    away = "2 * 6371.0D * asin(sqrt(least(1.0D, pow(sin(radians(x.latitude - element_at(s.done, -1).latitude) / 2), 2) + cos(radians(element_at(s.done, -1).latitude)) * cos(radians(x.latitude)) * pow(sin(radians(x.longitude - element_at(s.done, -1).longitude) / 2), 2))))"
    pick = f"array_min(transform(s.left, x -> struct({away} AS d, x.stop_no AS stop_no, x AS stop))).stop"
    text = f"""aggregate(sequence(1, greatest(size(known) - 1, 1)),
      CAST(named_struct('done', slice(known, 1, 1), 'left', slice(known, 2, greatest(size(known) - 1, 1))) AS struct<done: {kind}, left: {kind}>),
      (s, i) -> IF(size(s.left) = 0, s, named_struct('done', concat(s.done, array({pick})), 'left', filter(s.left, y -> y.stop_no <> {pick}.stop_no))))"""
    ordered = listed.select("trip_id", F.concat(F.when(F.size("known") > 0, F.expr(text)["done"]).otherwise(F.col("known")), F.col("rest")).alias("r"))
    out = ordered.select("trip_id", F.posexplode("r").alias("visit_no", "s"))
    return out.select("trip_id", (F.col("visit_no") + 1).alias("visit_no"), F.col("s.stop_no").alias("stop_no"), F.col("s.place_id").alias("place_id"))


#: Reach of a trip in its first day, and more for each other day.
TRIP_KM, KM_PER_DAY = 40.0, 25.0
#: The first cone of places that are looked at for trips, in kilometres.
CONE_KM = 10.0


def select_for_trip(trips: DataFrame, places: DataFrame) -> DataFrame:
    """``trip_id, place_id, score, pick``: well-known places near each trip's start, as many as its days can hold.

    ``trips`` has ``trip_id, latitude, longitude, days, hours``. A trip wants a place for every two hours and two more, within a
    reach that grows with its days. Popularity less half the distance ranks them; no category takes more than half of the
    wanted number unless the others don't fill it.

    A kilometre costs half a point, so popularity is a distance, too: the places that can be picked first lie in a cone
    below the highest popularity. Cones grow until they surely hold all that trips from one start can want. Trips that want
    the same are served once.
    """
    wanted = (F.greatest(F.lit(2.0), F.bround(F.col("days") * F.greatest(F.lit(2.0), F.col("hours")) / 2)) + 2).cast("int")
    asked = written(trips.select("trip_id", "latitude", "longitude", (TRIP_KM + KM_PER_DAY * (F.col("days") - 1)).alias("reach"), wanted.alias("wanted")).where("latitude IS NOT NULL AND longitude IS NOT NULL"), "trip-starts")
    spots = asked.groupBy("latitude", "longitude").agg(F.min("reach").alias("near"), F.max("reach").alias("far"), F.max("wanted").alias("most"))
    spots = written(spots.withColumn("spot", F.monotonically_increasing_id()), "trip-spots")
    known = F.coalesce("popularity_score", F.lit(0.0))
    kind = F.coalesce(F.nullif("category_name", F.lit("")), F.lit("Other"))
    rows = places.select("place_id", "latitude", "longitude", kind.alias("kind"), known.alias("known"))
    widest, (top, low) = spots.agg(F.max("far")).first()[0], rows.agg(F.max("known"), F.min("known")).first()
    if widest is None or top is None:
        return asked.select("trip_id", F.lit(0).cast("long").alias("place_id"), F.lit(0.0).alias("score"), F.col("wanted").alias("pick")).where("false")
    rows = rows.withColumn("below", 2 * (F.lit(top) - F.col("known")))
    order = [F.desc("score"), F.asc("place_id")]
    half = lambda n: F.greatest(F.lit(2), F.floor((F.col(n) + 1) / 2))
    of_kind = F.row_number().over(Window.partitionBy("spot", "beyond", "kind").orderBy(*order))
    nth = F.row_number().over(Window.partitionBy("spot", "beyond").orderBy("over", *order))
    left, found, cost, last = spots, None, CONE_KM, False
    while not last:
        last = cost >= widest + 2 * (top - low) or cost > CONE_KM * 1.6**12
        some = rows if last else rows.where(F.col("below") <= cost)
        met = distance_join(left, some, widest if last else min(cost, widest), "spot").join(left.select("spot", "near", "far", "most"), "spot").where("distance_km <= far")
        met = met if last else met.where(F.col("below") + F.col("distance_km") <= cost)
        # Places that all trips of the start reach: no more of a kind than the one that wants most takes.
        met = met.select("spot", "place_id", "kind", "distance_km", "most", (F.col("distance_km") > F.col("near")).alias("beyond"), (F.col("known") - 0.5 * F.col("distance_km")).alias("score"))
        met = met.withColumn("of_kind", of_kind).where(F.col("beyond") | (F.col("of_kind") <= (F.col("most") if last else half("most"))))
        met = met.withColumn("over", (~F.col("beyond") & (F.col("of_kind") > half("most"))).cast("int")).withColumn("nth", nth)
        met = written(met.where("beyond OR over = 1 OR nth <= most").select("spot", "place_id", "kind", "distance_km", "score", "most", (~F.col("beyond") & (F.col("over") == 0)).alias("sure"), "nth"), "trip-places")
        if not last:
            full = met.where("sure").groupBy("spot", "most").agg(F.max("nth").alias("n")).where("n >= most").select("spot")
            met, left = met.join(full, "spot", "left_semi"), written(left.join(full, "spot", "left_anti"), "trip-spots-left")
            last = left.isEmpty()
        found = met if found is None else found.unionByName(met)
        cost *= 1.6
    wish = ["latitude", "longitude", "reach", "wanted"]
    wishes = asked.select(*wish).distinct().join(spots.select("latitude", "longitude", "spot"), ["latitude", "longitude"])
    scored = wishes.join(found.select("spot", "place_id", "kind", "distance_km", "score"), "spot").where("distance_km <= reach")
    own = ["spot", "reach", "wanted"]
    over = (F.row_number().over(Window.partitionBy(*own, "kind").orderBy(*order)) > half("wanted")).cast("int")
    pick = F.row_number().over(Window.partitionBy(*own).orderBy("over", *order))
    picks = scored.withColumn("over", over).withColumn("pick", pick).where("pick <= wanted").select(*wish, "place_id", "score", "pick")
    return asked.join(picks, wish).select("trip_id", "place_id", "score", "pick")
