"""What queries compare grows with their input: pairs behind a result are counted."""

import random

import pandas as pd

from pyspark.sql import functions as F

from wayfarer.operators import nearby, places as P, recommend as R, resolve, similarity, spelling as Y, trips as T
from wayfarer.plans import details, ingest


def counting(monkeypatch, module, name):
    """Rows of every table that ``module.name`` gives."""
    rows, plain = [], getattr(module, name)

    def counted(*args, **kwargs):
        df = plain(*args, **kwargs)
        rows.append(df.count())
        return df

    monkeypatch.setattr(module, name, counted)
    return rows


def places(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(i, 10 + rng.random(), 77 + rng.random(), ["A", "B", "C", None][i % 4], rng.random() * 100, "X") for i in range(n)]
    return spark.createDataFrame(rows, "place_id long, latitude double, longitude double, category_name string, popularity_score double, district string")


def test_messages_meet_few_places(spark, sf, monkeypatch):
    asked, plain = [], P.top_per
    monkeypatch.setattr(details.P, "top_per", lambda df, *more: asked.append(df.count()) or plain(df, *more))
    got = details.m7(spark, sf)
    assert asked[0] <= 2 * 25 * 200  # districts and kinds by places, whatever the number of messages
    assert got.count() > 0 and got.where("nth > 8").count() == 0
    many = details.view(spark, sf, "messages").count()
    assert asked[0] < many * 200 / 25


def test_users_of_one_wish_share_it(spark, monkeypatch):
    names = {}
    plain = R.written
    monkeypatch.setattr(R, "written", lambda df, name: names.setdefault(name, plain(df, name)))
    df = places(spark, 2500).withColumns({"rating": F.lit(4.0), "rating_count": F.lit(9).cast("long"), "suitability": F.lit(1.0)})
    users = [(i, "X", None, None, None, float(i)) for i in range(20)] + [(100 + i, f"Y{i}", None, 10.5, 77.5, 20.0) for i in range(20)]
    got = R.recommend_users(spark.createDataFrame(users, "user_id long, district string, interest string, latitude double, longitude double, radius_km double"), df, 6)
    by_user = {r.user_id: (r.n, r.m, r.d) for r in got.groupBy("user_id").agg(F.count("*").alias("n"), F.max("nth").alias("m"), F.countDistinct("nth").alias("d")).collect()}
    assert all(by_user[i] == (2500, 2500, 2500) for i in range(20)) and all(by_user[100 + i] == (6, 6, 6) for i in range(20))
    assert names["wishes"].count() == 2  # neither radius nor district counts where it decides nothing


def test_searches_meet_what_they_show(spark, monkeypatch):
    pairs = counting(monkeypatch, nearby, "distance_join")
    df = places(spark, 2000)
    points = spark.createDataFrame([(1, 10.5, 77.5), (2, 10.4, 77.6), (3, 30.0, 77.5), (4, -60.0, -100.0), (5, None, 1.0)], "point_id long, latitude double, longitude double")
    got = nearby.start_search(points, df, "point_id", 10, 100.0).collect()
    assert sum(pairs) < 1000
    exact = points.crossJoin(df.withColumnsRenamed({"latitude": "y", "longitude": "x"})).withColumn("d", nearby.haversine_km(F.col("latitude"), F.col("longitude"), F.col("y"), F.col("x"))).where("d IS NOT NULL").collect()
    for p in (1, 2):
        assert {r.place_id for r in got if r.point_id == p} == {r.place_id for r in exact if r.point_id == p and r.d <= 10}
    for p in (3, 4):
        best = sorted((r.d, r.place_id) for r in exact if r.point_id == p)[:10]
        assert sorted((r.distance_km, r.place_id) for r in got if r.point_id == p) == best
    assert {r.point_id for r in got} == {1, 2, 3, 4}


def test_trips_meet_what_they_can_want(spark, monkeypatch):
    pairs = counting(monkeypatch, T, "distance_join")
    df, rng = places(spark, 3000), random.Random(5)
    starts = [(10 + rng.random(), 77 + rng.random()) for _ in range(5)] + [(9.3, 77.5), (40.0, 10.0)]
    trips = [(i, *starts[i % 7], 1 + i // 7 % 5, 5.0 + i % 4) for i in range(70)]
    got = {}
    for r in T.select_for_trip(spark.createDataFrame(trips, "trip_id long, latitude double, longitude double, days int, hours double"), df).collect():
        got.setdefault(r.trip_id, []).append((r.pick, r.place_id))
    assert sum(pairs) < 3000 * 7
    t = spark.createDataFrame([s for s in enumerate((y, x) for y, x in starts)], "s int, p struct<y: double, x: double>")
    away = t.crossJoin(df).select("s", "place_id", "category_name", "popularity_score", nearby.haversine_km(F.col("p.y"), F.col("p.x"), F.col("latitude"), F.col("longitude")).alias("d")).collect()
    for i, _, _, days, hours in trips:
        n = int(max(2, round(days * hours / 2))) + 2
        near = sorted((-(r.popularity_score - 0.5 * r.d), r.place_id, r.category_name) for r in away if r.s == i % 7 and r.d <= 40 + 25 * (days - 1))
        seen, ranked = {}, []
        for score, place, kind in near:
            seen[kind] = seen.get(kind, 0) + 1
            ranked.append((seen[kind] > max(2, (n + 1) // 2), score, place))
        assert sorted(got.get(i, [])) == [(k, place) for k, (_, _, place) in enumerate(sorted(ranked)[:n], 1)], i


def test_what_a_name_says_is_worked_out_once(spark):
    df = spark.createDataFrame([("Sri Ganesh Temple, Adyar", "Chennai")], "n string, d string")
    plan = df.select(Y.said(F.col("n"), F.col("d")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") <= 10


def test_spelling_pairs_over_a_join(spark):
    found = Y.spelling_pairs(ingest.spelt(spark, "/root/testdata/sf0.01"))
    assert found.count() == found.select("later", "earlier").distinct().count() == 233


def test_keys_of_many_scopes_are_compared_once(spark, monkeypatch):
    kept, plain = {}, similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    df = spark.createDataFrame([(s, k) for s in range(10) for k in ("large ring", "large rings", "gear")], "scope int, a string")
    got = similarity.alike(df, df.withColumnRenamed("a", "b"), ["scope"], "a", "b", 0.9)
    assert got.count() == 10 * 5 and kept["alike-pairs"].count() == 5


def scanned(rows):
    """Links of the records of one key by trying every anchor in turn."""
    anchors, links = [], []
    for rid, lat, lon in rows:
        at = None if lat is None else (lat, lon)
        for anchor in anchors:
            if at is None or anchor[1] is None or resolve._km(at, anchor[1]) <= resolve.MERGE_KM:
                links.append((rid, anchor[0]))
                anchor[1] = anchor[1] or at
                break
        else:
            anchors.append([rid, at])
    return links


def test_records_try_few_anchors():
    rng = random.Random(9)
    for n, none_first, box in ((300, True, (10, 10.2, 77, 77.2)), (300, False, (10, 10.2, 77, 77.2)), (200, False, (89.9, 90, -180, 180)), (200, False, (-0.1, 0.1, 179.9, 180.1))):
        rows = [(i, *((rng.uniform(*box[:2]), rng.uniform(*box[2:])) if rng.random() < 0.9 and not (none_first and i < 2) else (None, None))) for i in range(n)]
        df = pd.DataFrame(rows, columns=["rid", "latitude", "longitude"]).assign(district="d", key="k")
        got = pd.concat(resolve._anchored(iter([df[:50], df[50:]])))
        assert list(got.itertuples(index=False, name=None)) == scanned(rows)
    tried = []
    for n in (2000, 8000):
        anchors = resolve.Anchors()
        for i in range(n):
            anchors.meet(i, (rng.uniform(8, 13), rng.uniform(76, 80)))
        tried.append(anchors.tried / n)
    assert tried[1] < 10  # all anchors were some 5,000


def test_a_clean_name_is_worked_out_few_times(spark, sf):
    plan = details.er19(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 60  # 273 before


SPELT = "place_id long, district string, place_name string, latitude double, longitude double, merged_names string, location_precision string, source_count int, popularity_score double"


def namesakes(n, seed=7):
    """Places of few names, most of them without a surveyed position, some with a village."""
    rng = random.Random(seed)
    name = lambda: rng.choice(["Velsintora", "Velsintorra", "Felsintora", "Quinmaravelsintora"]) + rng.choice(["", "", " Lake", ", Quinmara", ", Quinmarra", ", Dolspet"])
    at = lambda: (rng.uniform(10, 10.12), rng.uniform(77, 77.12)) if rng.random() < 0.8 else (None, None)
    return [(i, rng.choice(["D", "E"]), name(), *at(), None, rng.choice([None, None, "locality"]), rng.randrange(4), float(rng.randrange(3))) for i in range(n)]


def test_rounds_store_no_more_than_places(spark, monkeypatch):
    kept, plain = [], Y.written
    monkeypatch.setattr(Y, "written", lambda df, name: kept.append((name, plain(df, name))) or kept[-1][1])
    rows = [(i, "D", "Velsintora", None, None, None, None, 1, float(i)) for i in range(400)]
    _, gone = Y.merge_rounds(spark.createDataFrame(rows, SPELT))
    assert {(r.place_id, r.keeper) for r in gone.collect()} == {(i, 399) for i in range(399)}
    assert max(df.count() for _, df in kept) <= 400  # 79,800 pairs before, and twice that


def test_pairs_of_namesakes_are_not_stored(spark, monkeypatch):
    kept, plain = [], Y.written
    monkeypatch.setattr(Y, "written", lambda df, name: kept.append(plain(df, name)) or kept[-1])
    df = spark.createDataFrame([(i, "D", "Velsintora", None, None, None, None, 1, float(i)) for i in range(200)], SPELT)
    assert Y.spelling_pairs(df).count() == 19_900
    assert max(k.count() for k in kept) <= 200  # 19,900 before
    kept.clear()
    assert Y.spelling_clusters(df).count() == 199
    assert max(k.count() for k in kept) <= 200


def test_survivors_are_aggregated_once(spark, monkeypatch):
    """A record is shuffled as it is, not as what a dozen aggregates hold of it, and not once for each of its sources."""
    rows = spark.createDataFrame([(i, f"P{i % 7}", "D", i % 5, None if i % 9 == 0 else i % 4, 10.0 + i % 3, 77.0, f"img{i % 6}", "Q1" if i % 2 else None) for i in range(60)], "rid long, place_name string, district string, source_rank int, source_id int, latitude double, longitude double, image_url string, external_id string")
    roots = spark.createDataFrame([(i, i % 7) for i in range(60)], "rid long, root long")
    got = resolve.survivors(rows.withColumn("image_source", F.lit(None).cast("string")), roots, ["place_name"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(root") == 1 and "root#" in plan and plan.count("hashpartitioning(root, ") <= 1 and "distinct" not in plan.lower().replace("array_distinct", "")
    assert "array_sort" not in plan  # its comparison is interpreted for each two elements
    sources = {k: [i % 4 for i in range(60) if i % 7 == k and i % 9] for k in range(7)}
    assert {r.root: (r.n_records, r.n_sources) for r in got.collect()} == {k: (len([i for i in range(60) if i % 7 == k]), len(set(v))) for k, v in sources.items()}


def test_components_leave_what_they_need(spark):
    """Stored rounds give what checkpoints give, and only the result's table stays."""
    import pathlib

    from wayfarer import session
    from wayfarer.operators import components

    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(500), rng.randrange(500)) for _ in range(400)], "a long, b long")
    folder = pathlib.Path(session.scratch_path(spark, "x")).parent
    before = set(folder.glob("components-*"))
    got = components.connected_components(edges, 10, keep=components.stored)
    want = components.connected_components(edges, 10)
    assert len(set(folder.glob("components-*")) - before) == 2  # some ten without dropping
    assert sorted(got.collect()) == sorted(want.collect())
