"""Timelines of visiting days: opening windows, the fold over stops, and the best order of a small day."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.functions.geo import haversine_km
from wayfarer.functions.score import drive_minutes

# Limits of a day, in minutes.
FIRST_LEG, LEG, WAIT = 240, 150, 270
LUNCH_FROM, LUNCH_UNTIL, LUNCH = 750, 870, 45
NOT_PREFERRED = 40
MAX_FREE = 7
#: Orders of days that a task tries at once.
MOST_AT_ONCE = 200_000

# Opening and preferred windows and the length of a visit by kind of place.
PROFILES = {
    "temple": ([(330, 750), (960, 1260)], [(330, 660), (1020, 1230)], 75),
    "wildlife": ([(360, 1080)], [(360, 660), (900, 1080)], 150),
    "waterfall": ([(420, 1080)], [(420, 960)], 90),
    "nature": ([(420, 1080)], [(420, 690), (900, 1080)], 75),
    "hill": ([(360, 1110)], [(360, 690), (900, 1110)], 120),
    "beach": ([(330, 1200)], [(330, 570), (960, 1170)], 90),
    "heritage": ([(540, 1050)], [(600, 960)], 75),
    "historical": ([(540, 1050)], [(600, 960)], 75),
    "cultural": ([(360, 1230)], [(480, 1170)], 45),
    "adventure": ([(600, 1080)], [(600, 1020)], 180),
}
DEFAULT_PROFILE = ([(480, 1140)], [(540, 1080)], 60)


def kind_of(category: Column, name: Column, profiles: dict) -> Column:
    """The category if it has a profile; names with certain words refine or overrule it."""
    low, title = F.lower(F.trim(category)), F.lower(F.coalesce(name, F.lit("")))
    known = F.when(low.isin(*profiles), low)
    broad = known.isNull() | known.isin("nature", "cultural")
    kind = F.when(broad & title.rlike("falls"), "waterfall").when(broad & title.rlike("dam|reservoir|park"), "nature").otherwise(known)
    return F.when(title.rlike("museum|gallery|palace|mahal"), "heritage").otherwise(kind)


def _windows(pairs: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(float(a)).alias("o"), F.lit(float(b)).alias("c")) for a, b in pairs])


def with_profile(df: DataFrame, profiles: dict = PROFILES) -> DataFrame:
    """Adds ``kind``, ``windows``, ``preferred`` and ``minutes`` (a stored visit length of 20 at least wins)."""
    kind = kind_of(F.col("category_name"), F.col("place_name"), profiles)
    out = df.withColumn("kind", kind)
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == k, _windows(p[i])) for k, p in profiles.items()], _windows(DEFAULT_PROFILE[i]))
    usual = F.coalesce(*[F.when(F.col("kind") == k, F.lit(p[2])) for k, p in profiles.items()], F.lit(DEFAULT_PROFILE[2]))
    stored = F.col("avg_visit_duration")
    return out.withColumns({"windows": pick(0), "preferred": pick(1), "minutes": F.when(stored >= 20, stored).otherwise(usual).cast("double")})


def timing_note(kind: Column, start: Column) -> Column:
    """Why a stop stands at its time of day."""
    hour = start / 60
    part = F.when(hour < 12, "morning").when(hour >= 16, "evening").otherwise("midday")
    return (
        F.when(kind == "temple", F.when(part == "midday", "temple hours vary at midday").otherwise(F.concat(F.lit("temple open in the "), part)))
        .when(kind == "wildlife", F.when(part == "morning", "animals are active early").otherwise("the park closes by six"))
        .when(kind.isin("waterfall", "nature", "hill"), F.when(part == "morning", "cool morning light").otherwise("a visit in daylight"))
        .when(kind.isin("heritage", "historical"), F.when(hour.between(11, 15.999), "shade in the heat of the day").otherwise("open in the daytime"))
        .when(kind == "beach", F.when(part == "evening", "evening breeze").otherwise("calm morning"))
        .otherwise("")
    )


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """Name an expression within another one."""
    return F.transform(F.array(value), f)[0]


_ENTRY = "struct<place_id: bigint, start_min: double, end_min: double, travel_min: double, wait_min: double>"
_STATE = f"struct<ok: boolean, now: double, lat: double, lon: double, cost: double, lunched: boolean, n: int, entries: array<{_ENTRY}>>"


def _visit(s: Column, x: Column, day_end: float) -> Column:
    """The state after stop ``x``: drive, lunch, first window that fits, visit."""
    first = s["n"] == 0
    travel = F.when(first & s["lat"].isNull(), 0.0).otherwise(drive_minutes(haversine_km(s["lat"], s["lon"], x["latitude"], x["longitude"])))
    eats = ~s["lunched"] & (s["now"] >= LUNCH_FROM) & (s["now"] < LUNCH_UNTIL)

    def arrived(a: Column) -> Column:
        begins = F.transform(x["windows"], lambda w: F.when(F.greatest(a["arrive"], w["o"]) + x["minutes"] <= w["c"], F.greatest(a["arrive"], w["o"])))
        return _let(F.filter(begins, lambda b: b.isNotNull()), lambda fit: placed(a, F.try_element_at(fit, F.lit(1))))

    def placed(a: Column, slot: Column) -> Column:
        noon = F.greatest(a["arrive"], F.lit(float(LUNCH_FROM)))
        waits_lunch = ~a["lunched"] & (noon < LUNCH_UNTIL) & (noon + LUNCH <= slot)
        wait = slot - a["arrive"] - F.when(waits_lunch, float(LUNCH)).otherwise(0.0)
        liked = F.exists(x["preferred"], lambda p: (p["o"] <= slot) & (slot + x["minutes"] <= p["c"]))
        most = F.when(first, FIRST_LEG).otherwise(LEG)
        ok = s["ok"] & (a["travel"] <= most) & slot.isNotNull() & (slot - a["arrive"] <= WAIT) & (slot + x["minutes"] <= day_end)
        entry = F.struct(x["place_id"].alias("place_id"), slot.alias("start_min"), (slot + x["minutes"]).alias("end_min"), a["travel"].alias("travel_min"), wait.alias("wait_min"))
        return F.struct(
            F.coalesce(ok, F.lit(False)).alias("ok"), (slot + x["minutes"]).alias("now"), F.coalesce(x["latitude"], s["lat"]).alias("lat"), F.coalesce(x["longitude"], s["lon"]).alias("lon"),
            (s["cost"] + a["travel"] + 0.6 * wait + F.when(liked, 0.0).otherwise(float(NOT_PREFERRED))).alias("cost"),
            (a["lunched"] | waits_lunch).alias("lunched"), (s["n"] + 1).alias("n"), F.concat(s["entries"], F.array(entry)).alias("entries"),
        ).cast(_STATE)

    here = lambda t: F.struct(t.alias("travel"), (s["lunched"] | eats).alias("lunched"), (s["now"] + F.when(eats, float(LUNCH)).otherwise(0.0) + t).alias("arrive"))
    return _let(travel, lambda t: _let(here(t), arrived))


def timeline(stops: Column, day_start: float = 540.0, day_end: float = 1260.0) -> Column:
    """Entries and cost of visiting an array of profiled stops in order; null where they don't fit the day."""
    null = F.lit(None).cast("double")
    start = F.struct(F.lit(True).alias("ok"), F.lit(day_start).alias("now"), null.alias("lat"), null.alias("lon"), F.lit(0.0).alias("cost"), F.lit(False).alias("lunched"), F.lit(0).alias("n"), F.array().cast(f"array<{_ENTRY}>").alias("entries")).cast(_STATE)
    end = F.aggregate(stops, start, lambda s, x: _visit(s, x, day_end))
    return _let(end, lambda e: F.when(e["ok"], F.struct(e["entries"].alias("entries"), e["cost"].alias("cost"))))


def day_stops(stops: DataFrame, keys: list[str]) -> DataFrame:
    """The profiled stops of each day as one ordered array.

    Days are few bytes and much work, so their partitions are of a fixed number and not merged by size.
    """
    one = F.struct("stop_no", "place_id", "latitude", "longitude", "windows", "preferred", "minutes")
    spark = stops.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    listed = with_profile(stops.repartition(parts, *keys)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("stop_no").alias("k"), one.alias("x")))).alias("s"))
    return listed.withColumn("stops", F.transform("s", lambda e: e["x"])).drop("s")


def _padded(lists: pa.ListArray, field: str, fill: float, null: float = np.nan) -> np.ndarray:
    """A field of lists of structs as a matrix, a row for each list; lists that are shorter are filled up."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(int)
    out = np.full((len(lists), max(1, sizes.max(initial=0))), fill)
    out[np.arange(out.shape[1]) < sizes[:, None]] = pc.fill_null(pc.struct_field(lists.flatten(), field), null).to_numpy(zero_copy_only=False)
    return out


def _drives(legs: pa.ListArray, n: int) -> np.ndarray:
    """Minutes of a leg by day, the stops that latitude and longitude of its start are of (``n``: none), and its end."""
    days, size = len(legs), n * (n - 1) // 2
    minutes = legs.flatten().to_numpy(zero_copy_only=False).reshape(days, -1)
    out = np.full((days, n + 1, n + 1, n), 30.0)
    if minutes.shape[1] == size:
        i, j = np.tril_indices(n, -1)
        out[:, i, i, j] = out[:, j, j, i] = minutes
    else:
        out[:, :n, :n] = minutes.reshape(days, n, n, n)
    return out


def _best(stops: pa.ListArray, legs: pa.ListArray, n: int, day_start: float, day_end: float) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest order of each of some days of ``n`` stops, the first of equal ones, and whether there is any.

    All days go through :func:`_visit` at once, in the same arithmetic; orders that begin alike share their beginning.
    """
    days, flat = len(stops), stops.flatten()
    part = lambda name: pc.struct_field(flat, name)
    opens, closes = (_padded(part("windows"), f, -np.inf, null).reshape(days, n, -1) for f, null in (("o", -np.inf), ("c", np.nan)))
    likes, until = (_padded(part("preferred"), f, np.nan).reshape(days, n, -1) for f in ("o", "c"))
    minutes = part("minutes").to_numpy(zero_copy_only=False).astype(float).reshape(days, n)
    known = tuple(part(f).is_valid().to_numpy(zero_copy_only=False).reshape(days, n) for f in ("latitude", "longitude"))
    drives, day = _drives(legs, n), np.arange(days)[:, None]

    orders = [()]
    ok, lunched = np.ones((days, 1), bool), np.zeros((days, 1), bool)
    now, cost, at = np.full((days, 1), day_start), np.zeros((days, 1)), [np.full((days, 1), n)] * 2
    for nth in range(n):
        grown = [(k, order, x) for k, order in enumerate(orders) for x in range(n) if x not in order]
        before, to, orders = [k for k, _, _ in grown], [x for _, _, x in grown], [(*order, x) for _, order, x in grown]
        ok, lunched, now, cost, at = ok[:, before], lunched[:, before], now[:, before], cost[:, before], [a[:, before] for a in at]
        travel = drives[day, at[0], at[1], to] if nth else np.zeros_like(now)
        eats = ~lunched & (now >= LUNCH_FROM) & (now < LUNCH_UNTIL)
        lunched, arrive, visit = lunched | eats, now + np.where(eats, float(LUNCH), 0.0) + travel, minutes[:, to]
        begins = np.maximum(arrive[..., None], opens[:, to])
        fits = begins + visit[..., None] <= closes[:, to]
        slot = np.where(fits.any(-1), np.take_along_axis(begins, fits.argmax(-1)[..., None], -1)[..., 0], np.nan)
        noon = np.maximum(arrive, float(LUNCH_FROM))
        waits_lunch = ~lunched & (noon < LUNCH_UNTIL) & (noon + LUNCH <= slot)
        wait = slot - arrive - np.where(waits_lunch, float(LUNCH), 0.0)
        now = slot + visit
        liked = ((likes[:, to] <= slot[..., None]) & (now[..., None] <= until[:, to])).any(-1)
        ok = ok & (travel <= (LEG if nth else FIRST_LEG)) & (slot - arrive <= WAIT) & (now <= day_end)
        cost = cost + travel + 0.6 * wait + np.where(liked, 0.0, float(NOT_PREFERRED))
        lunched, at = lunched | waits_lunch, [np.where(k[:, to], to, a) for k, a in zip(known, at, strict=True)]
    best = np.where(ok, cost, np.inf).argmin(1)
    return np.array(orders)[best] + 1, ok[np.arange(days), best]


def _positions(stops: pa.ListArray, legs: pa.ListArray, max_free: int, day_start: float, day_end: float) -> pa.Array:
    """The positions of the stops in the best order of each day, null where no order fits."""
    sizes, told = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (stops, legs))
    out: list[np.ndarray | None] = [np.arange(1, n + 1) if n > max_free else None for n in sizes]
    for n, size in sorted({(n, t) for n, t in zip(sizes.tolist(), told.tolist(), strict=True) if 0 < n <= max_free}):
        rows, some = np.flatnonzero((sizes == n) & (told == size)), max(1, MOST_AT_ONCE // math.factorial(n))
        for part in np.split(rows, range(some, len(rows), some)):
            orders, fits = _best(stops.take(pa.array(part)), legs.take(pa.array(part)), n, day_start, day_end)
            for row, order in zip(part[fits], orders[fits], strict=True):
                out[row] = order
    return pa.array(out, pa.list_(pa.int32()))


def best_order(days: DataFrame, keys: list[str], max_free: int = MAX_FREE) -> DataFrame:
    """The cheapest feasible order of each day; days of more than ``max_free`` stops keep theirs.

    All orders of a day are tried, in Arrow batches over the drives between its stops, and the best one's timeline is worked
    out in columns; nothing is shuffled.
    """
    day_start, day_end = 540.0, 1260.0
    drive = lambda a, b, c: drive_minutes(haversine_km(a["latitude"], b["longitude"], c["latitude"], c["longitude"]))
    # The way there is as long as the way back; only where half a position is known does a leg start at that of two stops.
    half = F.exists("stops", lambda x: x["latitude"].isNull() != x["longitude"].isNull())
    ways = F.flatten(F.transform("stops", lambda x, i: F.transform(F.slice("stops", F.lit(1), i), lambda y: drive(x, x, y))))
    mixed = F.flatten(F.flatten(F.transform("stops", lambda x: F.transform("stops", lambda y: F.transform("stops", lambda z: drive(x, y, z))))))
    legs = F.when(F.size("stops") > max_free, F.array().cast("array<double>")).when(half, mixed).otherwise(ways)
    told = days.where(F.size("stops") > 0).select(*keys, "stops", legs.alias("legs"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _positions(batch.column("stops"), batch.column("legs"), max_free, day_start, day_end)
            columns = [*(batch.column(c) for c in (*keys, "stops")), found]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "stops", "positions"]).filter(found.is_valid())

    schema = T.StructType([*(told.schema[c] for c in (*keys, "stops")), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    timed = timeline(F.transform("positions", lambda i: F.element_at("stops", i)), day_start, day_end)
    best = F.explode(F.filter(F.array(timed), lambda b: b.isNotNull())).alias("b")  # a generator: worked out once
    return told.mapInArrow(search, schema).select(*keys, best).select(*keys, "b.cost", "b.entries")


def never_schedulable(stops: DataFrame, day_start: int, day_end: int) -> DataFrame:
    """Stops whose visit fits no opening window within the day."""
    fits = F.exists("windows", lambda w: F.greatest(w["o"], F.lit(float(day_start))) + F.col("minutes") <= F.least(w["c"], F.lit(float(day_end))))
    return with_profile(stops).where(~fits)
