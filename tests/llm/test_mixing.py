import random

import numpy as np

from wayfarer.llm import mixing as M


def water_fill(sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    total, target, full = sum(sizes), [0.0] * len(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(3 * s for s, f in zip(sizes, full, strict=True) if f)
        w = sum(x for x, f in zip(weights, full, strict=True) if not f)
        target = [3.0 * s if f else rest * x / w for s, x, f in zip(sizes, weights, full, strict=True)]
        over = [not f and t > 3 * s for t, s, f in zip(target, sizes, full, strict=True)]
        if not any(over):
            return target
        full = [f or o for f, o in zip(full, over, strict=True)]


def test_targets(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 11):
        sizes = [rng.choice([0, 1, 10, 500, 90000]) for _ in range(n)]
        names = [f"s{i:02d}" for i in range(n - 1)] + [None]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
        got = {r.source: r.target for r in M.source_targets(df).collect()}
        assert np.allclose([got[x] for x in names], water_fill(sizes) if sum(sizes) else [0] * n)


def test_flight_keeps_its_sums():
    rng = np.random.default_rng(3)
    p, size = rng.uniform(0, 1, 300), rng.integers(1, 40, 300).astype(float)
    q = M.flight(p, size, rng, leave=2)
    assert abs(p.sum() - q.sum()) < 1e-6 and abs((p * size).sum() - (q * size).sum()) < 1e-4
    assert ((q > 0) & (q < 1)).sum() <= 2


def test_mix_is_near_its_targets_and_repeatable(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        source = rng.choices(["a", "b", "c", None], [60, 10, 29, 1])[0]
        rows.append((i, " ".join(["w"] * min(4000, int(rng.paretovariate(0.8) * 5))), source, 0.0))
    rows += [(5000, None, "a", 0.0), (5001, "", "b", 0.0), (None, "x y", "c", 0.0), (7, "r r r", "b", 0.0), (7, "r r r", "b", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = M.mix(df, block_rows=200).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", "c", None):
        own = [r for r in got if r.source == s]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(20, 0.001 * own[0].target)
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in got)
    key = lambda r: (str(r.doc_id), r.text_crc32, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, M.mix(df.repartition(5), block_rows=200).collect()))
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in M.mix(df).collect())
    assert M.mix(df.where("false")).count() == 0


def test_repeated_rows_are_emitted_as_often_as_the_mix_takes_them(spark):
    rows = [(i // 2, f"t{i // 2} " * (5 + i // 2 % 9), "a" if i // 2 % 3 else "b") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, drawn = {}, {}
    for r in M.mix(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
        drawn.setdefault(r.doc_id, []).append(r.copies)
    assert any(0 in c and max(c) > 0 for c in drawn.values())
    got = {r.doc_id: r["count"] for r in M.mixed_documents(df).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_equal_rows_are_one_unit(spark):
    """Two thirds of the rows are two rows; a flight sees each of them once, and its draw is a number."""
    rows = [(None, "", "a", i % 2) for i in range(1500)] + [(None, "w " * 7, "a", i % 2) for i in range(1500)] + [(i, "w " * (i % 40 + 1), "ab"[i % 2], 0) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    units = M.mixed_units(df, 200).collect()
    assert len(units) == 1502 and {r.rows for r in units} == {1, 1500} and all(0 <= r.extra <= r.rows for r in units)
    got = M.mix(df, 200).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
    [hot] = [r for r in units if r.size == 7 and r.doc_id is None]
    share = hot.target / hot.source_size
    assert abs(hot.whole * 1500 + hot.extra - 1500 * share) <= 1
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns
    text = {(i, len(t.split())): t for i, t, *_ in rows}
    expected = {(r.doc_id, text[r.doc_id, r.size]): r.whole * r.rows + r.extra for r in M.mixed_units(df).collect()}
    counts = {(r.doc_id, r.text): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    assert counts == {k: n for k, n in expected.items() if n}
    again = M.mixed_documents(df.repartition(7))
    key = lambda d: sorted((str(r.doc_id), r.text, r.copies) for r in d.collect())
    assert key(mixed) == key(again)  # which of rows that differ elsewhere is taken doesn't follow the partitions
