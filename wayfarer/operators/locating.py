"""Positions of places that have none, from a gazetteer of settlements and places of worship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.functions.geo import haversine_km
from wayfarer.functions.names import core_name_key, hidden_localities, settlement_key, split_locality
from wayfarer.operators import similarity
from wayfarer.session import written

#: Ratio from which village names, temple names near a village and temple names anywhere in a district count as one.
VILLAGE, TEMPLE, LONE_TEMPLE = 0.92, 0.86, 0.93
#: Temples lie so near to their village; villages of one name farther apart are two; rivals lie farther than this.
ANCHOR_KM, SPREAD_KM, RIVAL_KM = 6.0, 12.0, 1.0


def alike(left: DataFrame, right: DataFrame, a: str, b: str, at_least: float) -> DataFrame:
    """``district, a, b, score``: keys of one district whose ratio reaches ``at_least``."""
    return similarity.alike(left, right, ["district"], a, b, at_least)


def village_index(gazetteer: DataFrame) -> DataFrame:
    """``district, village, rank, lat, lon``: settlements by the keys of their names."""
    rows = gazetteer.where("kind = 'settlement'").select("district", "rank", "lat", "lon", F.explode("names").alias("name"))
    return written(rows.select("district", settlement_key(F.col("name")).alias("village"), "rank", "lat", "lon").where("village <> ''").distinct(), "villages")


def temple_index(gazetteer: DataFrame) -> DataFrame:
    """``worship_id, district, lat, lon, candidate``: places of worship by the cores of their names."""
    rows = gazetteer.where("kind = 'worship'").select("worship_id", "district", "lat", "lon", F.explode("names").alias("name"))
    return written(rows.select("worship_id", "district", "lat", "lon", core_name_key(F.col("name")).alias("candidate")).where("candidate <> ''").distinct(), "worship")


def anchors(asked: DataFrame, villages: DataFrame, fuzzy: bool) -> DataFrame:
    """``place_id, district, rank, lat, lon``: the settlements of the first locality of each place that has any.

    Localities of the name and the town come first (like spellings count if ``fuzzy``), then villages hidden in the
    name, by equal keys of five letters at least.
    """
    split = split_locality(F.col("place_name"), F.col("city_town"), F.col("district"))
    rows = asked.withColumn("s", split)
    told = rows.select("place_id", "district", F.posexplode("s.localities").alias("n", "text"))
    hidden = rows.select("place_id", "district", F.posexplode(hidden_localities(F.col("s.head"), ~F.col("is_temple"))).alias("n", "text"))
    keyed = told.unionByName(hidden.withColumn("n", F.col("n") + 1000)).select("place_id", "district", "n", settlement_key(F.col("text")).alias("key"))
    named = written(keyed.where("length(key) >= IF(n < 1000, 3, 5)"), "localities")
    hits = named.join(villages, (named.district == villages.district) & (named.key == villages.village)).select("place_id", named.district, "n", "rank", "lat", "lon")
    if fuzzy:
        missed = named.where("n < 1000").join(villages.select("district", F.col("village").alias("key")).distinct(), ["district", "key"], "left_anti")
        close = alike(villages, missed, "village", "key", VILLAGE)
        nth = F.row_number().over(Window.partitionBy("district", "key").orderBy(F.desc("score"), F.desc("village")))
        # Of all spellings the three nearest count, and of those the ones with the same first letter.
        close = close.withColumn("nth", nth).where("nth <= 3 AND left(village, 1) = left(key, 1)").select("district", "key", "village")
        near = missed.join(close, ["district", "key"]).join(villages, ["district", "village"])
        hits = hits.unionByName(near.select("place_id", "district", "n", "rank", "lat", "lon"))
    hits = written(hits, "anchors")
    first = hits.groupBy("place_id", "district").agg(F.min("n").alias("n"))
    return hits.join(first, ["place_id", "district", "n"]).drop("n").distinct()


def temples(asked: DataFrame, known: DataFrame, near: DataFrame) -> DataFrame:
    """``place_id, district, lat, lon``: the temple of the district whose name is most alike.

    Near an anchor of the place if it has any; else the name alone has to decide, and none is taken that has a rival of
    nearly the same score elsewhere.
    """
    head = split_locality(F.col("place_name"), F.col("city_town"), F.col("district"))["head"]
    rows = written(asked.where("is_temple").select("place_id", "district", core_name_key(head).alias("core")).where(F.length("core") >= 4), "cores")
    anchored = near.select("place_id", "district").distinct().withColumn("anchored", F.lit(True))
    rows = rows.join(anchored, ["place_id", "district"], "left").fillna(False, ["anchored"])
    scores = alike(rows, known, "core", "candidate", TEMPLE)
    met = rows.join(scores, ["district", "core"]).join(known, ["district", "candidate"])
    best = ["place_id", "district", "anchored", "worship_id", "lat", "lon"]
    met = written(met.groupBy(*best).agg(F.max("score").alias("score")), "temples")
    beside = met.where("anchored").join(near.select("place_id", "district", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")), ["place_id", "district"])
    beside = beside.where(haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon")) <= ANCHOR_KM).select(*best, "score")
    pool = beside.unionByName(met.where(f"NOT anchored AND score >= {LONE_TEMPLE}").select(*best, "score"))
    top = F.min_by(F.struct("worship_id", "lat", "lon", "score"), F.struct((-F.col("score")).alias("s"), F.col("worship_id").alias("w"))).alias("top")
    chosen = pool.groupBy("place_id", "district").agg(top)
    both = met.where("NOT anchored").join(chosen, ["place_id", "district"])
    apart = haversine_km(F.col("lat"), F.col("lon"), F.col("top.lat"), F.col("top.lon")) > RIVAL_KM
    rivals = both.where((F.col("score") >= LONE_TEMPLE) & (F.col("score") >= F.col("top.score") - 0.02) & apart)
    return chosen.join(rivals.select("place_id", "district").distinct(), ["place_id", "district"], "left_anti").select("place_id", "district", F.col("top.lat").alias("lat"), F.col("top.lon").alias("lon"))


def search(asked: DataFrame, villages: DataFrame, worship: DataFrame, fuzzy: bool) -> DataFrame:
    """``place_id, district, lat, lon, how``: the temple itself ("exact"), else the centre of the village ("locality")
    unless villages of that name lie far apart."""
    near = written(anchors(asked, villages, fuzzy), "near")
    exact = temples(asked, worship, near)
    exact = written(exact.withColumn("how", F.lit("exact")), "exact")
    rest = near.join(exact, ["place_id", "district"], "left_anti")
    first = rest.groupBy("place_id", "district").agg(F.min(F.struct("rank", "lat", "lon")).alias("f"))
    apart = F.max(haversine_km(F.col("f.lat"), F.col("f.lon"), F.col("lat"), F.col("lon"))).alias("km")
    spread = rest.join(first, ["place_id", "district"]).groupBy("place_id", "district", "f").agg(apart).where(F.col("km") <= SPREAD_KM)
    return exact.unionByName(spread.select("place_id", "district", F.col("f.lat").alias("lat"), F.col("f.lon").alias("lon"), F.lit("locality").alias("how")))


def locate(places: DataFrame, gazetteer: DataFrame, related: DataFrame) -> DataFrame:
    """``place_id, latitude, longitude, how`` of the places that can be located.

    ``places`` has ``place_id, place_name, city_town, district, is_temple`` and ``gazetteer`` ``worship_id, district,
    kind, rank, lat, lon, names`` (kind is settlement or worship). Who isn't found in its own district is looked for in
    the related ones, there by equal village names only; the first of them by name counts. Blank names and places
    without a district aren't found; like spellings are found by a join over rare runs of letters.
    """
    asked = written(places.select("place_id", F.coalesce("place_name", F.lit("")).alias("place_name"), "city_town", "district", F.coalesce("is_temple", F.lit(False)).alias("is_temple")).where("district IS NOT NULL"), "asked")
    villages, worship = village_index(gazetteer), temple_index(gazetteer)
    own = written(search(asked, villages, worship, True), "own")
    left = asked.join(own.select("place_id"), "place_id", "left_anti")
    elsewhere = left.join(related, "district").drop("district").withColumnRenamed("related", "district")
    beyond = search(elsewhere, villages, worship, False)
    beyond = beyond.groupBy("place_id").agg(F.min(F.struct("district", "lat", "lon", "how")).alias("b")).select("place_id", "b.lat", "b.lon", F.concat(F.lit("related "), "b.how").alias("how"))
    found = own.select("place_id", "lat", "lon", "how").unionByName(beyond)
    return found.select("place_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "how")
