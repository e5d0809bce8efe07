"""Cases of locating places by villages and temples."""

from wayfarer.operators.locating import locate

PLACES = [
    (1, "Old Fort, Kaniyambadi", None, "N", False),  # the village, as it is written
    (2, "Old Fort", "Kaniyambaddii", "N", False),  # folded to the same key
    (3, "Old Fort", "Kaniyambadir", "N", False),  # a like spelling
    (4, "Old Fort, Twinpur", None, "N", False),  # two villages of that name far apart
    (5, "Murugan Temple, Kaniyambadi", None, "N", True),  # the temple near its village
    (6, "Kailasanathar Temple", None, "N", True),  # one in the district
    (7, "Ekambaranathar Temple", None, "N", True),  # two of one name
    (8, "Memorial at Poompuhar", None, "N", False),
    (9, "Poompuhar Beach", None, "N", False),
    (10, "Old Fort, Farawayur", None, "N", False),  # in a related district
    (11, "Old Fort, Farawayurr Nadu", None, "N", False),  # there only equal names count
    (12, "Kaniyambadi", None, None, False),
    (13, None, None, "N", None),
    (14, "Murugan Temple, Poompuhar", None, "N", True),  # its village has no temple near: the village
    (15, "Shiva", None, "M", True),
]
SETTLED = [
    ("N", "settlement", 1, 12.80, 79.10, ["Kaniyambadi"]),
    ("N", "settlement", 1, 11.00, 79.00, ["Twinpur"]),
    ("N", "settlement", 2, 12.00, 79.00, ["Twinpur"]),
    ("N", "settlement", 3, 11.14, 79.85, ["Poompuhar", "Puhar"]),
    ("M", "settlement", 1, 10.50, 78.50, ["Farawayur"]),
    ("N", "worship", 1, 12.81, 79.11, ["Murugan Kovil"]),
    ("N", "worship", 1, 10.10, 77.50, ["Murugan Kovil"]),
    ("N", "worship", 1, 12.50, 79.50, ["Kailasanathar Kovil"]),
    ("N", "worship", 1, 12.60, 79.50, ["Ekambaranathar"]),
    ("N", "worship", 1, 12.70, 79.70, ["Ekambaranathar"]),
]


def tables(spark, places, settled):
    p = spark.createDataFrame(places, "place_id long, place_name string, city_town string, district string, is_temple boolean")
    g = spark.createDataFrame([(n, *row) for n, row in enumerate(settled)], "worship_id long, district string, kind string, rank int, lat double, lon double, names array<string>")
    return p, g, spark.createDataFrame([("N", "M")], "district string, related string")


def test_locate(spark):
    found = {r.place_id: (r.how, r.latitude) for r in locate(*tables(spark, PLACES, SETTLED)).collect()}
    assert found == {
        1: ("locality", 12.80), 2: ("locality", 12.80), 3: ("locality", 12.80), 5: ("exact", 12.81), 6: ("exact", 12.50),
        8: ("locality", 11.14), 9: ("locality", 11.14), 10: ("related locality", 10.50), 14: ("locality", 11.14),
    }


def test_nothing_to_locate(spark):
    assert locate(*tables(spark, [], SETTLED)).count() == 0
    assert locate(*tables(spark, PLACES, [])).count() == 0
