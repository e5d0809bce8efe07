import math
import zlib
from collections import Counter

import numpy as np

from wayfarer.llm import sharding as S


def test_matrix_sums():
    m = S.communication_matrix([7, 0, 1000, 13], 6, 1)
    assert m.sum(1).tolist() == [7, 0, 1000, 13] and max(m.sum(0)) - min(m.sum(0)) <= 1
    draws = np.array([S.communication_matrix([50, 50], 2, s)[0, 0] for s in range(400)])
    assert abs(draws.mean() - 25) < 0.5 and 4 < draws.var() < 9  # hypergeometric: 6.3


def test_draws_beyond_the_limit_of_numpy():
    """With a lowered limit all draws go by splitting; their frequencies are the exact ones."""
    rng = np.random.default_rng(3)
    for good, bad, n in ((7, 12, 6), (3, 30, 20), (10, 0, 4), (0, 9, 5), (5, 5, 10), (6, 6, 0)):
        draws = Counter(S.hypergeometric(rng, good, bad, n, population=2) for _ in range(6000))
        for k in range(n + 1):
            exact = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
            assert abs(draws[k] / 6000 - exact) < 0.03
    big = [S.hypergeometric(rng, 3 * 10**12, 10**12, 10**12) for _ in range(50)]
    assert abs(np.mean(big) / 7.5e11 - 1) < 1e-5 and len(set(big)) > 1


def test_every_row_goes_anywhere(spark):
    """Over many seeds each row reaches each shard and each slot about equally often, and pairs part as they should."""
    df = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "doc_id long, text string")
    seen, together = Counter(), 0
    for seed in range(60):
        got = {r.doc_id: (r.shard, r.slot) for r in S.shard_rows(df, 3, seed, cell_rows=4).collect()}
        seen.update((i, *v) for i, v in got.items())
        together += got[0][0] == got[1][0]
    assert all(sum(seen[i, s, k] for k in range(4)) >= 8 for i in range(12) for s in range(3))  # 20 expected
    assert all(sum(seen[i, s, k] for s in range(3)) >= 4 for i in range(12) for k in range(4))  # 15 expected
    assert abs(together / 60 - 3 / 11) < 0.2


def test_exact_sizes_slots_and_edge_cases(spark):
    rows = [(i, f"text {i % 7}", "x") for i in range(500)] + [(None, None, "x"), (None, "", "x"), (3, "text 3", "x"), (3, "text 3", "x"), (9, "é" * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = S.shard_rows(df, 24, cell_rows=40).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == expected
    again = S.shard_rows(df.repartition(3), 24, cell_rows=40).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert S.shard_rows(df.where("false")).count() == 0
    assert S.shard_rows(df.limit(3), 24).count() == 3


def test_equal_rows_are_spread_over_cells(spark):
    rows = [(None, "")] * 3000 + [(i, "t") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.shard_rows(df, 6, cell_rows=100).collect()
    assert len(got) == 3500
    for s in range(6):
        own = [r for r in got if r.shard == s]
        assert len(own) in (583, 584) and sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.doc_id is None for r in own) - 500) < 60
        slots = sorted(r.slot for r in own if r.doc_id is not None)
        assert max(b - a for a, b in zip(slots, slots[1:], strict=False)) < 60  # mixed, not in a block


def test_rows_are_repeated_in_parts(spark):
    from wayfarer.llm._common import repeated

    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 25), ("d", 7)], "k string, n long")
    got = sorted((r.k, r["copy"]) for r in repeated(df, "n", 7).collect())
    assert got == sorted((k, i) for k, n in (("b", 1), ("c", 25), ("d", 7)) for i in range(n))
