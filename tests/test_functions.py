import pytest
from pyspark.sql import functions as F

from wayfarer.functions import geo as G, score as S, text as X


def one(spark, **columns):
    """The row that expressions give."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_haversine_and_boxes(spark):
    r = one(
        spark,
        d=G.haversine_km(F.lit(13.0827), F.lit(80.2707), F.lit(9.9252), F.lit(78.1198)), none=G.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)),
        zero=G.haversine_km(F.lit(10.0), F.lit(78.0), F.lit(10.0), F.lit(78.0)), ok=G.valid_coordinates(F.lit("10.12345678"), F.lit("78.5")), out=G.valid_coordinates(F.lit("60"), F.lit("78.5")), bad=G.valid_coordinates(F.lit("x"), F.lit("NaN")),
    )
    assert abs(r.d - 423) < 4 and r.none is None and r.zero == 0
    assert tuple(r.ok) == (10.123457, 78.5) and tuple(r.out) == (None, None) and tuple(r.bad) == (None, None)


@pytest.mark.parametrize(("level", "name"), [("0.1", "Low"), ("0.5", "Medium"), ("0.9", "High"), ("1.5", "Unknown"), ("not a number", "Unknown"), (None, "Unknown"), ("0.33", "Low"), ("0.66", "Medium")])
def test_crowd_classes(spark, level, name):
    assert one(spark, c=S.classify_crowd(F.lit(level))).c == name


def test_scores(spark):
    null = F.lit(None).cast("double")
    r = one(
        spark,
        best=S.recommendation_score(F.lit(0.0), F.lit(5.0), F.lit(100.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)), nothing=S.recommendation_score(null, null, null, null, null, null, F.lit(1.0)),
        closed=S.recommendation_score(F.lit(0.0), F.lit(5.0), F.lit(100.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.2)), far=S.recommendation_score(F.lit(10.0), null, null, null, null, null, null),
        few=S.weighted_rating_bayes(F.lit(5.0), F.lit(5)), many=S.weighted_rating_bayes(F.lit(5.0), F.lit(1000)), conf=S.rating_confidence(F.lit(-3)), pop=S.popularity(F.lit(5.0), F.lit(1000.0), F.lit(1e6)), kept=S.popularity(null, null, null, F.lit(42.0)),
    )
    assert (r.best, r.nothing, r.closed, r.far) == (100.0, 0.0, 20.0, 12.5)
    assert r.few == pytest.approx((5 * 0.005 + 3.5 * 0.995) * 0.9, abs=1e-4) and r.many == 5.0 and r.conf == 0 and r.pop == 100.0 and r.kept == 42.0


def test_status_and_costs(spark):
    null = F.lit(None).cast("double")
    r = one(spark, a=S.status_suitability(null, F.lit("Path UNSAFE")), b=S.status_suitability(F.lit(7.0), F.lit("closed")), c=S.status_suitability(null, F.lit(None).cast("string")), t=S.transport_cost(F.lit(-4.0), F.lit(8.0)), f=S.food_cost(F.lit(0), F.lit(0), F.lit(300.0)), n=S.accommodation_cost(F.lit(2), F.lit(-1), F.lit(700.0)), w=S.drive_minutes(null), x=S.drive_minutes(F.lit(0.1)), y=S.drive_minutes(F.lit(20.0)), s=S.season(F.lit(7)), u=S.season(F.lit(0)))
    assert (r.a, r.b, r.c, r.t, r.f, r.n) == (0.2, 1.0, 1.0, 0.0, 300.0, 0.0)
    assert (r.w, r.x, r.y) == (30.0, 0.0, 50.0) and (r.s, r.u) == ("Monsoon", "Unknown")


@pytest.mark.parametrize(
    ("given", "key"),
    [("Sri Meenakshi Amman Temple", "meenakshi amman temple"), ("Meenakshi  Amman Temple.", "meenakshi amman temple"), ("Rock & Fort", "rock and fort"), ("Café Été", "cafe ete"), (None, ""), ("The", "")],
)
def test_name_keys(spark, given, key):
    assert one(spark, k=X.name_key(F.lit(given).cast("string"))).k == key


def test_phonetic_keys_meet(spark):
    a, b = (one(spark, k=X.phonetic_key(X.name_key(F.lit(n)))).k for n in ("Thiruparankundram", "Tirupparankundram"))
    assert a == b


@pytest.mark.parametrize(
    ("given", "clean"),
    [("12. AYYANAR KOVIL", "Ayyanar Kovil"), ("Marina Beach - Read more", "Marina Beach"), ("AYYANAR Kovil MGR", "Ayyanar Kovil MGR"), ("  Hill  View, ", "Hill View"), ("", "")],
)
def test_clean_names(spark, given, clean):
    assert one(spark, k=X.clean_place_name(F.lit(given))).k == clean


@pytest.mark.parametrize(("name", "junk"), [("Parks and Gardens", True), ("Privacy policy", True), ("ab", True), ("www.site.org", True), ("Madurai District", True), ("Hogenakkal Falls", False), (None, True)])
def test_junk_names(spark, name, junk):
    assert one(spark, k=X.junk_name(F.lit(name).cast("string"), F.lit("Madurai"))).k is junk


@pytest.mark.parametrize(("text", "category"), [("Hill Temple", "Temple"), ("St Mary Church", "Cultural"), ("Kutralam Falls", "Waterfall"), ("Vedanthangal Bird sanctuary", "Wildlife"), ("Botanical Garden", "Nature"), ("plain words", "Cultural")])
def test_categories(spark, text, category):
    assert one(spark, k=X.classify(F.lit(text), X.CATEGORY_RULES, "Cultural")).k == category


def test_small_text_functions(spark):
    r = one(
        spark,
        page=X.page_text(F.lit("<p>A &amp; B<script>x('</p>')</script>  <b>C</b>&nbsp;D</p>")), cut=X.truncate(F.lit("one two, three"), 9), whole=X.truncate(F.lit("short"), 8), parts=X.split_name_location(F.lit("Old Fort, Vellore")), bare=X.split_name_location(F.lit("Old Fort")),
        month=X.month_number(F.lit("Held in March or April")), none=X.month_number(F.lit("never")), minutes=X.minutes_of(F.lit("09:30")), bad=X.minutes_of(F.lit("soon")), clock=X.clock_of(F.lit(605)), words=X.keywords(F.lit("Show me the, big temples! the"), ["the", "show"]),
        file=X.hosted_file_title(F.lit("https://h/wiki/Special:FilePath/Old%20Fort_1.jpg?w=3")), other=X.hosted_file_title(F.lit("https://h/x.jpg")),
    )
    assert r.page == "A & B C D" and r.cut == "one two…" and r.whole == "short" and tuple(r.parts) == ("Old Fort", "Vellore") and tuple(r.bare) == ("Old Fort", None)
    assert (r.month, r.none, r.minutes, r.bad, r.clock) == (3, None, 570, None, "10:05") and r.words == ["big", "temples"] and r.file == "File:Old Fort 1.jpg" and r.other is None


def test_places_of_names_and_short_months(spark):
    columns = dict(
        tail=X.split_name_location(F.lit("Old Fort, built of stone")), dash=X.split_name_location(F.lit("Pykara Dam – New Ooty")), short=X.month_number(F.lit("12 Sept 2024")),
        may=X.month_number(F.lit("May be")), word=X.month_number(F.lit("maybe decorated")), few=S.classify_count(F.lit(10), F.lit(10), F.lit(20)), odd=S.classify_count(F.lit(10), F.lit(30), F.lit(20)),
        none=S.classify_count(F.lit("x"), F.lit(1), F.lit(2)),
    )
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    assert tuple(row.tail) == ("Old Fort, built of stone", None) and tuple(row.dash) == ("Pykara Dam", "New Ooty")
    assert (row.short, row.may, row.word, row.few, row.odd, row.none) == (9, 5, None, "Low", "Unknown", "Unknown")
