import hashlib
import random

import numpy as np
import pytest

from wayfarer.llm import vector_codes as V


def brute(rows, rounds=4):
    """rows (id, vector, label): the contract by plain loops over Python integers."""
    ok = [(i, [x for x in v], l) for i, v, l in rows if v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    width = -(-max((len(v) for _, v, _ in ok), default=0) // 4) * 4
    ok = [(i, [int(np.floor(1024 * x)) for x in v] + [0] * (width - len(v)), l) for i, v, l in ok]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in ok[:256]] for p in range(4)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            of = {}
            for _, v, _ in ok:
                of.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(x) // len(of[k]) for x in zip(*of[k], strict=True)] if k in of and w else e for k, e in enumerate(books[p])]
    found = []
    for i, v, l in ok:
        d = [near(cut(v, p), books[p]) for p in range(4)]
        found.append((i, "".join(f"{k:02x}" for _, k in d), sum(x for x, _ in d), l))
    total = {}
    for _, _, e, l in found:
        total[l] = total.get(l, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, total[l], sha) for i, c, e, l in found)


def got(spark, rows):
    df = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], "vec_id long, embedding array<double>, label int, code string")
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.compressed(df).collect())


def test_matches_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.1, 0.7]) for _ in range(8)], rng.choice([0, 1, None])) for i in range(320)]
    rows += [rows[3], (3, rows[9][1], 1), (None, rows[5][1], None), (900, [0.3] * 5, 1), (901, [], 0)]
    rows += [(910, None, 1), (911, [None] * 8, 1), (912, [float("nan")] + [1.0] * 7, 1), (913, [float("-inf")] * 8, None)]
    assert got(spark, rows) == brute(rows)


def test_few_rows_none_and_empty_vectors(spark):
    assert got(spark, [(1, [0.5, 1.0, 2.0, -3.0], 1), (2, [0.5, 1.0, 2.0, 3.0], None)]) == brute([(1, [0.5, 1.0, 2.0, -3.0], 1), (2, [0.5, 1.0, 2.0, 3.0], None)])
    assert got(spark, [(1, [], 1), (2, [], 1)]) == brute([(1, [], 1), (2, [], 1)])
    assert got(spark, [(1, None, 1)]) == []


def test_components_beyond_doubles_and_longs(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** (i % 16), 3.0, 2.0**50, 1e-9], i % 2) for i in range(40)]
    expected = [(i, c, min(e, 2**63 - 1), min(sum(min(x[2], 2**63 - 1) for x in brute(rows) if x[3] == t), 2**63 - 1), s) for i, c, e, t, s in brute(rows)]
    assert got(spark, rows) == expected
    assert len(got(spark, [(1, [1e30] * 4, 0), (2, [-1e30] * 4, 0)])) == 2


@pytest.mark.parametrize("scale, dim", [(3, 3), (1000, 16), (2**27, 8), (2**45, 4), (1, 1)])
def test_tree_is_exact_and_keeps_ties(scale, dim):
    rng = np.random.default_rng(scale + dim)
    for spread in (1, 20):  # loose and in clusters
        centres = rng.integers(-scale, scale + 1, (12, dim)) * spread
        entries = centres[rng.integers(0, 12, 256)] + rng.integers(-scale, scale + 1, (256, dim))
        entries[100:110] = entries[:10]
        q = np.concatenate([entries[rng.integers(0, 256, 300)], centres[rng.integers(0, 12, 300)] + rng.integers(-scale, scale + 1, (300, dim))])
        tree = V.Gnat(entries)
        index, far = tree.nearest(q)
        whole = q.astype(object)[:, None, :] - entries.astype(object)[None]
        d = (whole * whole).sum(axis=2)
        assert index.tolist() == [int(np.argmin(row)) for row in d]
        assert [int(x) for x in far] == [min(row) for row in d.tolist()]
        if spread == 20 and dim > 1:
            assert tree.compared < 0.75 * d.size  # whole groups are ruled out
