"""Links, districts of cards, letters, searches for many, messages, trips and wishes, against plain Python."""

import random
import unicodedata
from urllib.parse import urljoin

from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.operators import messages as M, pages as G, places as P, recommend as R, resolve as E, trips as T


def test_links_mean_what_a_browser_says(spark):
    pages = ["http://h.org", "http://h.org/", "http://h.org/a/b/c?x=1#y", "https://h.org/a/b/", "https://h.org:8080/a/../b/d.html"]
    hrefs = ["x", "./x", "../x", "../../x/", "../../../x", "/r", "/r/../s", "?q=1", "//other.net/p", "https://z.org/k", "mailto:a@b.c", "x/./y/../z", "x?u=../v", "..", "."]
    df = spark.createDataFrame([(u, h) for u in pages for h in hrefs], "url string, href string")
    got = {(r.url, r.href): r.link for r in df.withColumn("link", G.absolute_link(F.col("url"), F.col("href"))).collect()}
    assert got == {(u, h): urljoin(u, h) for u in pages for h in hrefs}


def test_every_letter_with_a_latin_base_is_plain(spark):
    letters = [chr(c) for c in range(0x80, 0x1FFFF) if not 0xD800 <= c < 0xE000]
    plain = {}
    for x in letters:
        whole = unicodedata.normalize("NFKD", x)
        bare = "".join(c for c in whole if not unicodedata.combining(c))
        if len(whole) and bare.isascii() and bare.isalnum() and len(bare) == 1:
            plain[x] = bare
    df = spark.createDataFrame([(x,) for x in [*plain, "é", "ﬁn", "Ǆ", "plain"]], "c string")
    got = {r.c: r.p for r in df.select("c", X.plain_letters(F.col("c")).alias("p")).collect()}
    assert len(plain) > 1000 and {x: got[x] for x in plain} == plain and (got["é"], got["ﬁn"], got["Ǆ"], got["plain"]) == ("e", "fin", "DZ", "plain")


def test_cards_and_lists(spark):
    cards = [(1, 0, "NORTH circle", "Old Fort (South)", None), (1, 1, "North district", "Lake (Upper Town)", "http://PORTAL.north.in/x"), (1, 2, "Nowhere", "Falls (big falls)", "/x"), (1, 3, None, "Plain", None), (1, 4, "north", "A (b) (Two Small Words)", "::bad")]
    df = spark.createDataFrame(cards, "page_id long, pos long, section string, card string, href string")
    aliases = spark.createDataFrame([("north", "North"), ("south", "South"), ("north circle", "North")], "alias string, district string")
    hosts = spark.createDataFrame([("portal.north.in", "Other")], "host string, district string")
    got = {r.pos: (r.name, r.district, r.town, r.how) for r in G.located_cards(df, aliases, hosts).collect()}
    assert got == {0: ("Old Fort", "South", None, "brackets"), 1: ("Lake", "Other", "Upper Town", "host"), 2: ("Falls", None, None, None), 3: ("Plain", None, None, None), 4: ("A (b)", "North", None, "section")}
    rows = spark.createDataFrame([(1, "A and B, C & A"), (2, " "), (3, None), (4, "Sandy")], "k long, d string")
    assert sorted((r.k, r.d or "") for r in G.split_lists(rows, "d").collect()) == [(1, "A"), (1, "B"), (1, "C"), (2, ""), (3, ""), (4, "Sandy")]
    texts = spark.createDataFrame([("Norht",), (" Elsewhere ",), ("SOUTH dist.",)], "d string")
    assert {r.d: r.canonical for r in E.canonical_district(texts, "d", aliases, 0.8).collect()} == {"Norht": "North", " Elsewhere ": "Elsewhere", "SOUTH dist.": "South"}


def view(spark):
    rng = random.Random(3)
    words = ["red", "fort", "lake", "old", "pier", "salt", "Gate", "mill"]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, pick(2), rng.choice(["North", "South"]), rng.choice([None, pick(1)]), "Home", rng.choice([None, pick(1)]), pick(3), None, rng.choice(["Fort", None]), float(rng.randrange(5)), float(rng.randrange(3))) for i in range(60)]
    return rows, spark.createDataFrame(rows, "place_id long, place_name string, district string, city_town string, state string, subcategory string, description string, address string, category_name string, popularity_score double, weighted_rating double")


def plain_search(rows, text, n):
    q, found = text.strip().lower(), []
    for r in rows:
        if q and any(q in (x or "").lower() for x in r[1:9]):
            name = r[1].lower()
            tier = 1 if name == q else 2 if name.startswith(q) else 3 if q in (r[3] or "").lower() else 4
            found.append((tier, -r[9], -r[10], r[1], r[0]))
    return [(x[-1], x[0]) for x in sorted(found)[:n]]


def test_many_searches_are_each_as_one(spark):
    rows, df = view(spark)
    asked = {1: "RED", 2: " lake old ", 3: "d f", 4: "e", 5: "zzz", 6: "  ", 7: None, 8: "North", 9: "red"}
    got = {}
    for r in P.search_many(df, spark.createDataFrame(list(asked.items()), "search_id long, text string"), 7).orderBy("nth").collect():
        got.setdefault(r.search_id, []).append((r.place_id, r.tier))
    assert got == {i: x for i, t in asked.items() if (x := plain_search(rows, t or "", 7))}
    one = [r.place_id for r in P.search_view(df.withColumn("category_id", F.lit(1)), "red", None, 7).collect()]
    assert one == [p for p, _ in plain_search(rows, "red", 7)]
    assert P.search_view(df.withColumn("category_id", F.lit(1)), " ", 1, 500).count() == 60 and P.by_text(df, "district", "NORTH").count() == sum(r[2] == "North" for r in rows) and P.by_text(df, "city_town", " ").count() == 0


def test_messages_and_mentions(spark):
    rows, df = view(spark)
    said = ["old pier", "Show me a (mill), near the GATE!", "of the in", "nothing here zz", None, " ", "fort", "fort"]
    messages = spark.createDataFrame(list(enumerate(said)), "conv_id long, message string")
    expected = {}
    for i, text in enumerate(said):
        whole = [p for p, _ in plain_search(rows, text or "", 4)]
        if not whole and text:
            words = [w.strip(".,!?;:()[]{}") for w in text.lower().split()]
            whole = list(dict.fromkeys(p for w in words if len(w) >= 3 and w not in M.STOP_WORDS for p, _ in plain_search(rows, w, 4)))[:4]
        if whole:
            expected[i] = whole
    got = {}
    for r in M.message_search(messages, df, ["conv_id"], M.STOP_WORDS, 4).orderBy("nth").collect():
        got.setdefault(r.conv_id, []).append(r.place_id)
    assert got == expected and set(got) == {0, 1, 6, 7} or got == expected
    mentions = spark.createDataFrame([(1, " 7 "), (2, "70000"), (3, "LAKE"), (4, ""), (5, None), (6, "9" * 30)], "mention_id long, text string")
    found = {r.mention_id: (r.place_id, r.how) for r in M.place_information(mentions, df).collect()}
    assert found == {1: (7, "id"), 3: (plain_search(rows, "lake", 1)[0][0], "search")}


def test_trips_choose_within_reach_and_kinds(spark):
    rng = random.Random(5)
    places = [(i, rng.choice([None, 10 + rng.random() * 1.5]), 78.0, rng.choice("aab") if rng.random() < 0.9 else None, rng.choice([None, *map(float, range(40))])) for i in range(120)]
    df = spark.createDataFrame(places, "place_id long, latitude double, longitude double, category_name string, popularity_score double")
    trips = [(1, 10.2, 78.0, 1, 8.0), (2, 10.7, 78.0, 3, 9.0), (3, 10.7, 78.0, 2, 0.5), (4, None, None, 2, 8.0), (5, 50.0, 0.0, 2, 8.0)]
    from wayfarer.operators.resolve import _km

    expected = {}
    for t, y, x, days, hours in trips:
        wanted = max(2, round(days * max(2.0, hours) / 2)) + 2
        near = [(p, (s or 0) - 0.5 * _km((y, x), (a, b)), c or "Other") for p, a, b, c, s in places if a is not None and y is not None and _km((y, x), (a, b)) <= 40 + 25 * (days - 1)]
        near.sort(key=lambda r: (-r[1], r[0]))
        first, seen = [], {}
        for p, _, c in near:
            seen[c] = seen.get(c, 0) + 1
            if seen[c] <= max(2, (wanted + 1) // 2):
                first.append(p)
        whole = first[:wanted] + [p for p, *_ in near if p not in first[:wanted]][: max(0, wanted - len(first[:wanted]))]
        if whole:
            expected[t] = whole
    got = {}
    for r in T.select_for_trip(spark.createDataFrame(trips, "trip_id long, latitude double, longitude double, days int, hours double"), df).orderBy("pick").collect():
        got.setdefault(r.trip_id, []).append(r.place_id)
    assert got == expected and len(got[2]) == 16
    assert T.select_for_trip(spark.createDataFrame([], "trip_id long, latitude double, longitude double, days int, hours double"), df).count() == 0


def test_wishes_are_served_once_and_reach_their_users(spark):
    places = [(i, "North" if i < 8 else "South", c, 10 + i / 100, 78.0, 4.0, 10 * i, float(i), 1.0) for i, c in enumerate(["Old Fort", "fort", "lake", None] * 5)]
    df = spark.createDataFrame(places, "place_id long, district string, category_name string, latitude double, longitude double, rating double, rating_count long, popularity_score double, suitability double")
    users = [(1, "north", "Fort", None, None, 5.0), (2, "NORTH", None, None, None, 5.0), (3, "x", "Fort", 10.0, 78.0, 6.0), (4, "x", "Fort", 10.0, 78.0, 6.0), (5, "x", None, 10.0, 78.0, 1000.0), (6, "none", None, None, None, None)]
    got = {}
    for r in R.recommend_users(spark.createDataFrame(users, "user_id long, district string, interest string, latitude double, longitude double, radius_km double"), df, 6).orderBy("nth").collect():
        got.setdefault(r.user_id, []).append(r.place_id)
    assert got[1] == [5, 1, 4, 0] and sorted(got[2]) == list(range(8)) and got[3] == got[4] and set(got[3]) == {0, 1, 4, 5} and len(got[5]) == 6 and 6 not in got
