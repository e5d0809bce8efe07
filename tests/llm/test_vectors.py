import math
import random

import numpy as np
import pytest

from wayfarer.llm import embedding_dedup as E, topk as K
from wayfarer.operators.components import UnionFind


def vectors(n=160, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    for i in range(40, n):  # neighbours at angles around the threshold
        j, cos = rng.integers(0, 40), rng.uniform(0.92, 0.96)
        a = base[j] / np.linalg.norm(base[j])
        b = rng.standard_normal(dim)
        b -= (b @ a) * a
        base[i] = cos * a + math.sqrt(1 - cos * cos) * b / np.linalg.norm(b)
    return base


def brute_links(rows):
    ok = [(k, i, np.array(v, float), l) for k, (i, v, l) in enumerate(rows) if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    pairs = [(a[0], b[0]) for x, a in enumerate(ok) for b in ok[x + 1 :] if a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.93]
    return pairs


def test_links_match_brute_force_and_edge_cases(spark):
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors())]
    rows += [(500 + k, rows[k][1], rows[k][2]) for k in range(5)] + [(0, rows[0][1], 0)]
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16]
    rows += [(600 + k, v, 1) for k, v in enumerate(bad)] + [(700, rows[1][1], None), (None, rows[1][1], 1), (701, [1.0] * 16, 1), (702, [2.0] * 16, 1), (703, [1.0] * 3, 1)]
    df = spark.createDataFrame([(i, v, l, 5) for i, v, l in rows], "vec_id long, embedding array<double>, label int, n_links int")
    pairs = brute_links(rows)
    n, sets = [0] * len(rows), UnionFind()
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
        sets.union(a, b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[sets.find(k)] = min(low.get(sets.find(k), i), i)
    expected = sorted((str(i), n[k], str(low.get(sets.find(k)))) for k, (i, _, _) in enumerate(rows))
    for chunk in (512, 7):
        got = E.embedding_links(df, chunk_rows=chunk).collect()
        assert len(got) == len(rows)
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == expected
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert E.embedding_links(df.where("false")).count() == 0


@pytest.mark.parametrize("rows", [2_000, 50_000, 1_000_000])
def test_recall_and_work_at_every_size(rows):
    """Pairs right at the threshold share a direction nearly always, whatever the number of directions."""
    rng = np.random.default_rng(11)
    words = E.code_words(rows)
    x = E.unit_rows(rng.standard_normal((600, 64)))
    y = rng.standard_normal((600, 64))
    y = E.unit_rows(y - (x * y).sum(1, keepdims=True) * x)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y
    own = []
    for v in (x, y):
        at, directions = E.decode(v, words)
        found = [set() for _ in range(600)]
        for r, d in zip(at.tolist(), directions.tolist(), strict=True):
            found[r].add(d)
        own.append(found)
        assert E.LISTS <= len(at) / 600 <= 2 * E.LISTS
        assert rows * len(at) / 600 / words**2 <= 2 * E.BUCKET  # vectors of a direction
    assert sum(bool(a & b) for a, b in zip(*own, strict=True)) / 600 >= 0.97


def test_top_k_matches_brute_force_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ROWS", 9)
    monkeypatch.setattr(K, "TILE_ROWS", 4)
    monkeypatch.setattr(K, "TILES", 2)
    monkeypatch.setattr(K, "SHARDS", 3)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(400)]  # many ties
    rows += [(1000, None), (1050, [None] * 6), (1100, [float("nan")] * 6), (None, [1.0] * 6), (1150, [1.0, 2.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in K.exact_top_k(df.where("vec_id % 50 = 0"), df).collect()}
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    expected = {}
    for i, q in ok:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in ok if j != i and len(c) == len(q))[:5]
            expected |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    assert got == expected
    assert K.exact_top_k(df.where("false"), df).count() == 0
    assert K.products(np.array([[1e15, 1.0]]), np.array([[1e3, 1.0]])).tolist() == [[10**18 + 1]]


def test_there_are_cells_for_all_tasks():
    for tiles, shards, tasks in [(1, 3, 16), (1, 64, 16), (4, 20, 64), (40, 1000, 200), (1, 1, 8), (300, 9000, 50)]:
        t, s = K.group_sizes(tiles, shards, tasks)
        cells = -(-tiles // t) * -(-shards // s)
        assert 1 <= t <= K.TILES and 1 <= s <= K.SHARDS and cells >= min(tasks, shards) and (t == min(K.TILES, tiles) or s == 1)
