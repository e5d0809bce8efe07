import itertools
import random
from urllib.parse import urljoin
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from wayfarer.functions.geo import EARTH_KM
from wayfarer.operators import nearby as N, pages as G, places as P, quality as C, resolve as E, trips as T, upsert as U
from wayfarer.operators.components import UnionFind, connected_components
from wayfarer.sources import records as IO


@pytest.mark.parametrize("small", [0, 3, 100_000])
def test_components(spark, small):
    rng = random.Random(small)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(5000, x) for x in range(5001, 5080)] + [(7, 7), (None, 3)]
    sets = UnionFind()
    for a, b in edges:
        if a is not None:
            sets.union(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r.node: r.root for r in connected_components(df, small).collect()}
    assert got == {x: sets.find(x) for x in {y for a, b in edges if a is not None and a != b for y in (a, b)}}
    assert connected_components(df.where("false"), small).count() == 0


def located(n, seed):
    rng = random.Random(seed)
    return [(i, rng.uniform(8, 13.6), rng.uniform(76, 80.5)) for i in range(n)] + [(n, None, 77.0)]


def km(a, b):
    import math

    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(h))


@pytest.mark.parametrize("lat", [0.0, 45.0, -60.0, 89.0, 90.0])
@pytest.mark.parametrize("radius", [30, 400])
def test_distance_join_anywhere(spark, lat, radius):
    """Around the equator, in the north and south, at a pole, and across 180 degrees."""
    rng = random.Random(lat + radius)
    spread = 4.0
    make = lambda n: [(i, max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), (180 + rng.uniform(-spread, spread) * (40 if abs(lat) > 80 else 1) + 180) % 360 - 180) for i in range(n)]
    points, places = make(40), make(120)
    p = spark.createDataFrame(points, "point_id long, latitude double, longitude double")
    q = spark.createDataFrame(places, "place_id long, latitude double, longitude double")
    got = {(r.point_id, r.place_id) for r in N.distance_join(p, q, radius, "point_id").collect()}
    assert got == {(i, j) for i, a, b in points for j, c, d in places if km((a, b), (c, d)) <= radius} and got
    nearest = {(r.point_id, r.nth): r.place_id for r in N.nearest(p, q, "point_id", 3).collect()}
    assert nearest == {(i, n + 1): j for i, a, b in points for n, (_, j) in enumerate(sorted((km((a, b), (c, d)), j) for j, c, d in places)[:3])}


@pytest.mark.parametrize("radius", [5, 40, 150])
def test_distance_join_loses_no_pair(spark, radius):
    points, places = located(20, 1), located(150, 2)
    p = spark.createDataFrame(points, "point_id long, latitude double, longitude double")
    q = spark.createDataFrame(places, "place_id long, latitude double, longitude double")
    got = {(r.point_id, r.place_id) for r in N.distance_join(p, q, radius, "point_id").collect()}
    assert got == {(i, j) for i, a, b in points for j, c, d in places if a is not None and c is not None and km((a, b), (c, d)) <= radius}


def test_adaptive_radius(spark):
    places = [(i, 10.0 + 0.02 * i, 78.0) for i in range(60)]
    q = spark.createDataFrame(places, "place_id long, latitude double, longitude double")
    p = spark.createDataFrame([(1, 10.0, 78.0), (2, 8.4, 78.0), (3, 30.0, 78.0)], "point_id long, latitude double, longitude double")
    got = N.adaptive_nearby(p, q, "point_id", k=10).groupBy("point_id").agg(F.max("radius_km").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    by = {r.point_id: (r.r, r.n) for r in got}
    # 0.02 degrees are 2.2 km: ten places lie within 30 km; the second point finds nothing within 100 km.
    assert by == {1: (30.0, sum(km((10.0, 78.0), (y, 78.0)) <= 30 for _, y, _ in places))}
    assert N.adaptive_nearby(p, q, "point_id", start=200.0).count() == 0


def test_nearest_neighbour_route_and_packing(spark):
    rng = random.Random(3)
    rows = []
    for trip in range(12):
        for s in range(1, 7):
            known = rng.random() > 0.2
            rows.append((trip, s, trip * 10 + s, rng.uniform(8, 13) if known else None, rng.uniform(76, 80) if known else None, rng.choice([None, 10, 60, 200, 700])))
    df = spark.createDataFrame(rows, "trip_id long, stop_no long, place_id long, latitude double, longitude double, avg_visit_duration long")
    got = {}
    for r in T.nearest_neighbour_route(df).orderBy("trip_id", "visit_no").collect():
        got.setdefault(r.trip_id, []).append(r.stop_no)
    for trip in range(12):
        own = [r for r in rows if r[0] == trip]
        left, route = [r for r in own if r[3] is not None], []
        while left:
            nxt = min(left, key=lambda r: (km((route[-1][3], route[-1][4]), (r[3], r[4])), r[1])) if route else left[0]
            route.append(nxt)
            left.remove(nxt)
        assert got[trip] == [r[1] for r in route] + [r[1] for r in own if r[3] is None]
    days = df.withColumn("days", F.lit(2))
    packed = {(r.trip_id, r.stop_no): (r.day, r.start_min, r.end_min) for r in T.pack_days(days).collect()}
    for trip in range(12):
        day, clock, stuck = 1, 540, False
        for r in (r for r in rows if r[0] == trip):
            minutes = max(r[5] if r[5] is not None else 120, 30)
            if clock + minutes > 1020:
                day, clock = day + 1, 540
            stuck = stuck or day > 2 or clock + minutes > 1020
            assert packed[trip, r[1]] == ((None, None, None) if stuck else (day, clock, clock + minutes))
            clock += minutes + 30


def test_search_and_fallback(spark):
    rows = [(1, "Old Fort", "Vellore", "Historical", "a fort", 9.0, 1.0), (2, "Fort", "Salem", "Hill", "x", 1.0, 1.0), (3, "Fort Road", "Fortia", "Hill", "y", 5.0, 1.0), (4, "Lake", "Fortia", "Nature", "z", 7.0, 1.0)]
    df = spark.createDataFrame(rows, "place_id long, place_name string, district string, category_name string, description string, popularity_score double, weighted_rating double")
    assert [r.place_id for r in P.search_places(df, "FORT", None, 10).collect()] == [2, 3, 4, 1]
    assert {r.place_id for r in P.district_or_all(df, "salem").collect()} == {2}
    assert {r.place_id for r in P.district_or_all(df, "none").collect()} == {1, 2, 3, 4}


def test_fuzzy_matching(spark):
    pairs = [("abcd", "abce"), ("kitten", "sitting"), ("", ""), ("abc", None), ("bcda", "abcd"), ("abcd", "bcda")]
    df = spark.createDataFrame(pairs, "a string, b string")
    from wayfarer.operators.ratios import consonants_agree

    got = [r.r for r in df.select(E.seq_ratio("a", "b").alias("r")).collect()]
    assert got == [None if b is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert consonants_agree("velmaritan", "felmarithan") is False and consonants_agree("torgubela", "dorkupela") and not consonants_agree("mesotavara", "melotavara")


def test_merging_and_survivors(spark):
    rows = [(1, 2, "a", "Sri Old Fort", "D", None, "x"), (2, 1, "b", "OLD FORT", "D", "Q1", None), (3, 3, "c", "Castle", "E", "Q1", " "), (4, 1, "a", "Old Fort", "F", None, None), (5, 9, "d", "the", "D", None, None), (6, 9, "d", "Sri", "D", None, None)]
    df = spark.createDataFrame(rows, "rid long, source_rank int, source_id string, place_name string, district string, external_id string, city string")
    roots = E.merge_records(df)
    assert {r.rid: r.root for r in roots.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    got = {r.root: r for r in E.survivors(df, roots, ["place_name", "city", "external_id"]).collect()}
    assert (got[1].place_name, got[1].city, got[1].external_id, got[1].n_records, got[1].n_sources) == ("OLD FORT", "x", "Q1", 3, 3)


def test_districts_resolve(spark):
    aliases = spark.createDataFrame([("nilgiris", "Nilgiris"), ("sivagangai", "Sivaganga"), ("salem", "Salem")], "alias string, district string")
    given = [("The Nilgris", "Nilgiris"), ("Sivagangai district", "Sivaganga"), ("SALEM ", "Salem"), ("Paris", None), (None, None)]
    df = spark.createDataFrame([(g,) for g, _ in given], "d string")
    got = {r.d: r.resolved for r in E.resolve_district(df, "d", aliases).collect()}
    assert got == dict(given)


def test_upserts_are_idempotent(spark):
    stored = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.9)], "id long, name string, relevance double")
    new = spark.createDataFrame([(2, None, 0.1), (3, "c", 0.2), (3, "c", 0.1)], "id long, name string, relevance double")
    once = U.upsert(stored, new, ["id"], ("relevance",))
    assert sorted(map(tuple, once.collect())) == [(1, "a", 0.5, "keep"), (2, "b", 0.9, "update"), (3, "c", 0.2, "insert")]
    twice = U.upsert(once.drop("change"), new, ["id"], ("relevance",))
    assert sorted(map(tuple, twice.drop("change").collect())) == sorted(map(tuple, once.drop("change").collect()))
    images = spark.createDataFrame([(1, "u1", True), (1, "u2", True)], "place_id long, image_url string, is_primary boolean")
    merged = U.add_images(images.where("image_url = 'u2'"), images)
    assert sorted(map(tuple, merged.collect())) == [(1, "u1", False), (1, "u2", True)]


def test_quality(spark):
    df = spark.createDataFrame([(1, " a  b ", 95.0, 10.0, "7"), (1, " a  b ", 95.0, 10.0, "7"), (2, "  ", None, None, None), (3, "c", 10.0, None, "x")], "id long, place_name string, latitude double, longitude double, rating string")
    assert C.clean(df.drop("rating")).count() == 2
    normal = {r.id: r for r in C.normalize(df).collect()}
    assert (normal[1].rating, normal[1].latitude, normal[1].place_name, normal[3].rating) == (5.0, None, "a b", 0.0)
    broken = {r.rule: r.n_rows for r in C.validate(df.drop("rating"), ["place_name", "city"]).collect()}
    assert broken == {"latitude out of range": 2, "longitude out of range": 0, "half a position": 1, "missing place_name": 1, "missing city": 4}


PAGE = """<html><head><title>Fort | Vellore | Tourism</title><meta name="description" content="An old fort"></head><body>
<h2>Temples</h2><p>Short.</p><h2>Forts</h2><h3>Inner</h3><p>Long text about the inner fort that has many words in it.</p>
<ul><li>Card one</li><li>Card two</li></ul><a href="/a">A</a><a href="b/c">B</a><a href="/a">again</a><a href="https://x.y/home">H</a>
<table><tr><th>Name of festival</th><th>Place</th></tr><tr><td>Car <b>festival</b></td><td>Vellore</td></tr><tr><td>Boat</td><td>Salem</td></tr></table></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "http://h.org/p/q", PAGE), (2, "http://h.org/", None)], "page_id long, url string, html string")
    title = G.titles(df).where("page_id = 1").first()
    assert (title.title_name, title.title_district, title.title_suffix, title.description) == ("Fort", "Vellore", "Tourism", "An old fort")
    assert sorted((r.link, r.first_pos) for r in G.links(df, ["home"]).collect()) == [("http://h.org/a", 0), (urljoin("http://h.org/p/q", "b/c"), 1)]
    assert [(r.heading, r.paragraph) for r in G.heading_sections(df).orderBy("pos").collect()][:3] == [("Temples", "Short."), ("Forts", None), ("Inner", "Long text about the inner fort that has many words in it. Card one Card two A B again H Name of festival Place Car festival Vellore Boat Salem")]
    assert sorted((r.name, r.place) for r in G.table_rows(df, {"name": "name", "place": "place"}).collect()) == [("Boat", "Salem"), ("Car festival", "Vellore")]
    assert [(r.section, r.card) for r in G.section_cards(df).orderBy("pos").collect()] == [("Inner", "Card one"), ("Inner", "Card two")]
    assert "inner fort" in G.summaries(df, "airport").first().summary


def test_records(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", name'), (2, None)], "id long, name string")
    for kind in ("csv", "json"):
        assert IO.write_records(df, f"{tmp_path}/r.{kind}")
        assert sorted(map(tuple, IO.read_records(spark, f"{tmp_path}/r.{kind}", df.schema).collect())) == [(1, 'a "quoted", name'), (2, None)]
    assert not IO.write_records(df.where("false"), f"{tmp_path}/e.csv")
    assert IO.read_records(spark, f"{tmp_path}/missing.csv", df.schema).count() == 0
    assert list(itertools.islice(IO.evolve(df, {"name": "string", "x": "double"}).columns, 3)) == ["id", "name", "x"]


def test_day_spans_cover_every_day(spark):
    lats = [10.0, 10.1, None, 11.0, 11.5, 11.2, 12.0]  # days of three: 1-3, 4-6, 7
    df = spark.createDataFrame([(1, i + 1, y, 78.0) for i, y in enumerate(lats)] + [(2, 5, 9.0, 78.0), (2, 6, 9.0, 78.0)], "trip_id long, stop_no int, latitude double, longitude double")
    got = {(r.trip_id, r.day): r.span_km for r in T.day_spans(df).collect()}
    degree = EARTH_KM * 3.141592653589793 / 180
    assert got == pytest.approx({(1, 1): 0.1 * degree, (1, 2): 0.5 * degree, (2, 2): 0.0})
