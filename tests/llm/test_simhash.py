import itertools
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from wayfarer.llm import simhash as S
from wayfarer.operators.components import UnionFind


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=4):
    sets = UnionFind()
    for a, b in itertools.combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= radius:
            sets.union(a, b)
    return [sets.find(x) for x in fps]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ABab \t\n\x0bÉé .", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), min_size=0, max_size=4))
def test_every_close_pair_collides(fp, bits):
    other = fp ^ sum(1 << b for b in bits)
    assert any(fp & m == other & m for m in S.covering_masks())


def test_components_match_brute_force_and_edge_cases(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base[:6]:
        for _ in range(6):
            w = t.split()
            w[rng.randrange(120)] = "changed"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (None, base[0]), (0, base[0]), (999, "one two")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, component_id string")
    got = S.simhash_components(df).collect()
    fps = [plain_fingerprint(t or "") for _, t in rows]
    roots = plain_components(fps)
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    expected = sorted((i if i is not None else -1, f, low.get(r, -1)) for (i, _), f, r in zip(rows, fps, roots, strict=True))
    assert sorted((g.doc_id if g.doc_id is not None else -1, g.fp % 2**64, g.component_id if g.component_id is not None else -1) for g in got) == expected
    assert S.simhash_components(df.where("false")).count() == 0


def test_crowded_buckets_are_linked_exactly(spark):
    """With a tiny bound nearly every bucket goes the way of shared variants."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = set(centres.tolist())
    for c in centres.tolist():
        x = c
        for _ in range(30):
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    for bound in (1, 3, 4096):
        sets = UnionFind()
        for r in S.fingerprint_links(df, 4, bound).collect():
            assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4
            sets.union(r.a % 2**64, r.b % 2**64)
        assert [sets.find(x) for x in fps] == plain_components(fps)
