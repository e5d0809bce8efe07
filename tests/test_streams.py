import datetime as dt

import pytest

from wayfarer.streaming import streams as ST


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


class Feed:
    """A folder of Parquet files that a stream reads; each call adds a file."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


def test_status_is_late_proof_goes_stale_by_itself_and_survives_restarts(spark, tmp_path):
    feed = Feed(spark, f"{tmp_path}/in", "place_id long, status_id long, status string, checked_at timestamp, expires_at timestamp")
    run = lambda: {r.place_id: (r.status_id, r.status, r.is_fresh) for r in ST.latest_status(feed.stream(), f"{tmp_path}/out", "3 hours").collect()}
    feed.add([(1, 10, "Open", at(10), at(12)), (2, 11, "Open", at(11), None), (1, 9, "Closed", at(10), at(12)), (None, 12, "Open", at(10), at(20))])
    assert run() == {1: (10, "Open", True), 2: (11, "Open", False), None: (12, "Open", True)}
    feed.add([(1, 5, "Closed", at(9, 30), at(23)), (3, 13, None, at(16), at(18))])  # late and older: nothing; 16:00 puts the stream at 13:00
    assert run() == {1: (10, "Open", False), 2: (11, "Open", False), None: (12, "Open", True), 3: (13, None, True)}
    feed.add([(1, 14, "Open again", at(16, 30), at(19)), (1, 15, "Closed", at(12), at(23)), (4, 16, "Open", at(1), at(23))])  # 4 is later than the delay
    assert run() == {1: (14, "Open again", True), 2: (11, "Open", False), None: (12, "Open", True), 3: (13, None, True)}
    feed.add([(5, 17, "Open", at(22, 30), at(23))])
    assert {k: v[2] for k, v in run().items()} == {1: False, 2: False, None: True, 3: False, 5: True}
    assert run()[1] == (14, "Open again", False)  # nothing new: the same table


def test_rollup_writes_what_changes_and_counts_deliveries_once(spark, tmp_path):
    feed = Feed(spark, f"{tmp_path}/in", "rating_id string, place_id long, rating double, review string, rating_date timestamp")
    out = f"{tmp_path}/out"
    run = lambda: {r.place_id: (r.n, r.rating, r.last_review) for r in ST.rating_rollup(feed.stream(), out).collect()}
    feed.add([("a", 1, 5.0, "  good ", at(1)), ("b", 1, 0.0, "no", at(1)), ("c", 2, 3.0, " ", at(1)), ("d", 2, None, "none", at(1)), ("e", 3, 4.0, "x" * 900, at(1))])
    first = {1: (1, 5.0, "good"), 2: (1, 3.0, None), 3: (1, 4.0, "x" * 500)}
    assert run() == first
    feed.add([("a", 1, 5.0, "  good ", at(1)), ("f", 2, 1.0, "late", at(0))])
    assert run() == first | {2: (2, 2.0, "late")}
    sizes = [spark.read.parquet(f"{out}/changes-{n}").count() for n in ST.ChangeLog(spark, out, ["place_id"], "place_id long")._numbers("changes")]
    assert sum(sizes) == 4  # three places, then the one that changed


def test_change_log_folds_and_repeats_a_batch(spark, tmp_path):
    log = ST.ChangeLog(spark, f"{tmp_path}/log", ["k"], "k long, v string", fold=3)
    assert log.read().count() == 0
    for n in range(8):
        log.write(spark.createDataFrame([(n % 3, f"v{n}"), (100 + n, "own")], "k long, v string"), n)
        log.write(spark.createDataFrame([(n % 3, f"v{n}"), (100 + n, "own")], "k long, v string"), n)  # a retry
        got = {r.k: r.v for r in log.read().collect()}
        assert got == {k: f"v{max(m for m in range(n + 1) if m % 3 == k)}" for k in range(min(3, n + 1))} | {100 + m: "own" for m in range(n + 1)}
    assert log._numbers("folded") == [5] and log._numbers("changes") == [3, 4, 5, 6, 7]


@pytest.mark.parametrize("moved", [6, 7])
def test_slices_keep_their_files(spark, tmp_path, moved):
    from wayfarer.operators import upsert as U

    path = f"{tmp_path}/slices"
    df = spark.createDataFrame([(1, "a", 6), (2, "b", 6), (3, "c", 7), (4, "d", None)], "id long, name string, source int")
    U.write_sliced(df, path, "source")
    files = lambda s: sorted(p.name for p in (tmp_path / "slices" / s).glob("*.parquet"))
    kept, before = (f"source={13 - moved}", f"source={moved}"), None
    before = {s: files(s) for s in (*kept, "source=__HIVE_DEFAULT_PARTITION__")}
    U.overwrite_slices(spark.createDataFrame([(9, "new", moved)], df.schema), path, "source")
    assert files(kept[0]) == before[kept[0]] and files("source=__HIVE_DEFAULT_PARTITION__") == before["source=__HIVE_DEFAULT_PARTITION__"]
    assert files(kept[1]) != before[kept[1]]
    rows = sorted(tuple(r) for r in spark.read.schema(df.schema).parquet(path).where("source IS NOT NULL").collect())
    assert rows == sorted([r for r in [(1, "a", 6), (2, "b", 6), (3, "c", 7)] if r[2] != moved] + [(9, "new", moved)])
