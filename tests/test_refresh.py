"""The write side of a refresh: cases of each rule, and whole runs against plain counts."""

import datetime as dt

from pyspark.sql import functions as F

from wayfarer.operators import refresh as W

PLACE = "place_id long, place_name string, district string, category_name string, city_town string, subcategory string, description string, latitude double, longitude double, address string, external_id string, map_id string, source_url string, tourism_relevance double, location_precision string, state string, merged_names string, popularity_score double"
NAMES = [c.split()[0] for c in PLACE.split(", ")]
DAY = dt.datetime(2024, 1, 1)


def rows(spark, items, key="place_id"):
    schema = PLACE.replace("place_id", key)
    return spark.createDataFrame([tuple((dict.fromkeys(NAMES) | {"place_id": i, "place_name": n, "district": d} | more).values()) for i, n, d, more in items], schema)


def test_records_update_what_they_match_and_the_rest_become_places(spark):
    stored = rows(spark, [
        (1, "Old Mill", "North", {"external_id": "E1", "city_town": "Aston", "tourism_relevance": 0.7, "location_precision": "locality", "latitude": 1.0, "longitude": 1.0, "state": "S"}),
        (2, "Salt Pier", "North", {"address": "Pier 1", "tourism_relevance": None}), (3, "Rock", "West", {"latitude": 1.0, "longitude": 1.0}), (4, "Quiet", "West", {"tourism_relevance": None}),
    ])
    new = rows(spark, [
        (10, "The Mill", "Else", {"external_id": "E1", "city_town": None, "description": "first", "tourism_relevance": 0.2, "latitude": 1.1, "longitude": 1.1}),
        (11, "Mill again", "Else", {"external_id": "E1", "description": "second", "subcategory": None}),
        (12, "SALT pier", "North", {"address": None, "map_id": "m"}), (13, "Rock", "North", {"latitude": 1.01, "longitude": 1.0}),
        (14, "Brand New", "South", {"city_town": "X"}), (15, "brand new", "South", {"address": "Y", "tourism_relevance": 0.9}), (16, "  ", "South", {}), (17, None, "South", {}),
    ], "new_id").drop("location_precision", "state", "merged_names", "popularity_score")
    related = spark.createDataFrame([("North", "West"), ("West", "North")], "district string, related string")
    up = W.upsert_places(stored, new, related, "Home")
    got = {r.place_id: r for r in up.places.collect()}
    mill = got[1]
    assert (mill.place_name, mill.district, mill.city_town, mill.description, mill.latitude, mill.location_precision, mill.tourism_relevance, mill.state, mill.change) == ("Mill again", "Else", "Aston", "second", 1.1, None, 0.7, "S", "update")
    assert (got[2].place_name, got[2].address, got[2].map_id, got[2].tourism_relevance) == ("SALT pier", "Pier 1", "m", 0.0)
    assert (got[3].district, got[3].latitude, got[3].change) == ("West", 1.01, "update")  # the district on record stays
    assert (got[4].change, got[4].tourism_relevance) == ("keep", None)
    ids = {r.new_id: (r.place_id, r.how) for r in up.ids.collect()}
    assert ids[14] == ids[15] and ids[14][1] == "insert" and sorted({v[0] for k, v in ids.items() if k >= 14}) == [5, 6, 7]
    both = got[ids[14][0]]
    assert (both.place_name, both.city_town, both.address, both.tourism_relevance, both.state, both.change) == ("brand new", "X", "Y", 0.9, "Home", "insert")
    assert W.upsert_places(stored, new.where("false"), related).places.where("change <> 'keep'").count() == 0
    assert W.upsert_places(stored.where("false"), new, related).places.count() == 6  # 10 and 11 share an id, 14 and 15 a name


def tables(spark):
    places = rows(spark, [
        (1, "Keep", "D", {"description": "four", "merged_names": "Was", "tourism_relevance": None}), (2, "Lend", "D", {"city_town": "B", "description": "five5", "tourism_relevance": 0.4, "merged_names": "Older|Oldest"}),
        (3, "Also", "D", {"city_town": "C", "map_id": "m3", "description": "5five"}), (9, "Apart", "D", {}),
    ])
    sources = spark.createDataFrame([(1, 7, "u", DAY), (2, 7, "u", DAY + dt.timedelta(1)), (2, 8, "u", DAY), (9, 7, "u", DAY)], "place_id long, source_id long, source_url string, last_seen timestamp")
    image = lambda p, u, first: (p, u, f"of{p}", None, None, first)
    images = spark.createDataFrame([image(1, "a", False), image(2, "a", True), image(2, "b", False), image(2, "c", True), image(3, "d", True), image(9, "a", True)], "place_id long, image_url string, image_source string, image_license string, image_author string, is_primary boolean")
    child = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (None, 4)], "place_id long, rating int")
    events = spark.createDataFrame([(100, 3), (101, None), (102, 9)], "festival_id long, associated_place_id long")
    return W.Tables(places, sources, images, {"ratings": child}, spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "place_id long, feature string"), events)


def test_absorbed_places_lend_what_the_keeper_lacks(spark):
    mapping = spark.createDataFrame([(2, 1), (3, 1)], "place_id long, keeper long")
    t = W.absorb(tables(spark), mapping)
    by = {r.place_id: r for r in t.places.collect()}
    keep = by[1]
    assert set(by) == {1, 9} and (keep.place_name, keep.city_town, keep.map_id, keep.description, keep.tourism_relevance, keep.merged_names) == ("Keep", "B", "m3", "five5", 0.4, "Was|Lend|Older|Oldest|Also")
    assert by[9].tourism_relevance is None and by[9].merged_names is None
    assert sorted((r.place_id, r.source_id, r.last_seen) for r in t.sources.collect()) == [(1, 7, DAY), (1, 8, DAY), (9, 7, DAY)]
    assert sorted((r.place_id, r.image_url, r.image_source, r.is_primary) for r in t.images.collect()) == [(1, "a", "of1", False), (1, "b", "of2", False), (1, "c", "of2", True), (1, "d", "of3", False), (9, "a", "of9", True)]
    assert sorted(str(r.place_id) for r in t.children["ratings"].collect()) == ["1", "1", "1", "None"]
    assert sorted(map(tuple, t.features.collect())) == [(1, "x"), (9, "z")]
    assert sorted((r.festival_id, r.associated_place_id) for r in t.events.collect()) == [(100, 1), (101, None), (102, 9)]
    same = W.absorb(tables(spark), mapping.where("false"))
    assert sorted(map(str, same.places.collect())) == sorted(map(str, tables(spark).places.collect())) and same.images.where("is_primary").count() == 4


def test_removed_places_take_their_rows_along(spark):
    t = W.remove(tables(spark), spark.createDataFrame([(9,), (9,), (None,)], "place_id long"))
    assert sorted(r.place_id for r in t.places.collect()) == [1, 2, 3] and t.images.where("place_id = 9").count() + t.sources.where("place_id = 9").count() + t.features.where("place_id = 9").count() == 0
    assert t.children["ratings"].count() == 4 and sorted((r.festival_id, r.associated_place_id) for r in t.events.collect()) == [(100, 3), (101, None), (102, None)]


def test_images_of_records(spark):
    stored = spark.createDataFrame([(1, "a", "old", "L", "A", False), (2, "b", "old", None, None, True)], "place_id long, image_url string, image_source string, image_license string, image_author string, is_primary boolean")
    image = "array<struct<image_url string, image_source string, image_license string, image_author string>>".replace(" string", ": string")
    new = spark.createDataFrame([(10, [("a", None, None, "N"), ("c", "s", None, None)]), (11, [("d", "s", "M", None)]), (12, [(None, "s", None, None), ("e", "s", None, None)]), (13, [])], f"new_id long, images {image}")
    ids = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 2)], "new_id long, place_id long")
    got = sorted((r.place_id, r.image_url, r.image_source, r.image_license, r.image_author, r.is_primary) for r in W.upsert_images(stored, new, ids).collect())
    # The first new image in a first position leads, since "a" was there before; place 2 keeps its choice.
    assert got == [(1, "a", None, "L", "N", False), (1, "c", "s", None, None, False), (1, "d", "s", "M", None, True), (2, "b", "old", None, None, True), (2, "e", "s", None, None, False)]


def test_hosted_images_are_described_or_go(spark):
    images = spark.createDataFrame([("h/1", None, "x"), ("h/2", "y", None), ("z", "own", "own"), (None, None, None)], "image_url string, image_author string, image_license string")
    meta = spark.createDataFrame([("h/1", "ann", "CC"), ("z", None, "CC")], "image_url string, image_author string, image_license string")
    got = {tuple(r) for r in W.described_images(images, meta, F.col("image_url").startswith("h/")).collect()}
    assert got == {("h/1", "ann", "CC"), ("z", "own", "CC"), (None, None, None)}


def test_numbers_have_no_gaps(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    got = W.numbered_after(df.repartition(7), ["k"], 50, "n").collect()
    assert sorted(r.n for r in got) == list(range(51, 3051))
    assert {r.k: r.n for r in got} == {r.k: r.n for r in W.numbered_after(df.repartition(3), ["k"], 50, "n").collect()}


def test_keepers_that_are_passed(spark):
    mapping = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8)], "place_id long, keeper long")
    assert {tuple(r) for r in W._ended(mapping).collect()} == {(5, 1), (4, 1), (3, 1), (9, 8)}


def test_report_of_a_run_is_what_the_tables_say(spark, sf):
    from wayfarer.plans.ingest import numbered, stored_tables
    from wayfarer.sources.tables import view

    t = stored_tables(spark, sf)
    t.places = t.places.where("place_id % 3 <> 0 AND place_id <= 60")
    t.events = t.events.withColumn("source_id", F.col("month"))
    records = numbered(spark, sf).where("record_key <= 70")
    meta = records.select("image_url", F.lit("ann").alias("image_author"), F.lit("CC").alias("image_license")).where("image_url LIKE '%/1'").distinct()
    junk = F.col("place_id") % 20 == 1
    june = t.events.where("month = 6").withColumn("festival_name", F.upper("festival_name"))
    after, report = W.refresh(t, records, view(spark, sf, "related_districts"), meta, F.col("image_url").endswith("/2"), junk, F.lit("2030-01-01").cast(t.sources.schema["last_seen"].dataType), june)
    n, stored = after.places.count(), t.places.count()
    assert report["records_seen"] == records.count() and report["places_total"] == n and report["districts"] == after.places.select("district").distinct().count()
    assert report["places_with_position"] == after.places.where("latitude IS NOT NULL AND longitude IS NOT NULL").count()
    assert n == stored + report["places_inserted"] - report["junk_removed"] - report["across_districts"] - report["by_spelling"]
    assert report["records_merged"] >= report["places_inserted"] + report["places_updated"] > 0 and report["junk_removed"] > 0
    assert after.places.where(junk).count() == 0 and after.places.where("popularity_score IS NULL").count() == 0
    kept = {r.place_id for r in after.places.collect()}
    assert len(kept) == n and {r.place_id for r in after.sources.where("year(last_seen) = 2030").collect()} <= kept
    own = after.images.groupBy("place_id").agg(F.count_if("is_primary").alias("n"))
    pictured = t.images.where("is_primary").select("place_id").distinct()
    assert own.join(pictured, "place_id", "left_anti").where("n > 1").count() == 0  # who had no primary image has one at most
    assert after.events.where("month = 6 AND festival_name <> upper(festival_name)").count() == 0 and after.events.count() == t.events.count()
