import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from wayfarer.llm import lexical as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(str(item), r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in L.ranked(d, q, k).collect()), key=str)


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Ümlaut", "İ", "ſ", "K", "naïve", "UPPER", "x1", "日本"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "_", "-", "\n", "\x7f"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(200)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (900, None), (901, ""), (902, "-- !"), (903, "w1 " * 30_000)]
    items = [(i, text(rng.randrange(1, 30))) for i in range(60)]
    items += [(1, items[1][1]), (1, "w3 w4"), (None, "w1 w2 w3 w1"), (70, None), (71, ""), (72, "absent"), (73, "W1 w1 upper UPPER"), (74, " ".join(words * 3))]
    return docs, items


def test_matches_brute_force_and_odd_rows(spark, monkeypatch):
    docs, items = corpus()
    expected = brute(docs, [(i, t or "") for i, t in items])
    assert got(spark, docs, items) == expected
    for name, value in (("BLOCK_ITEMS", 7), ("PASS_SYMBOLS", 200), ("CELLS", 600), ("MINED", 5), ("PIECE_BYTES", 50), ("MERGE_WAYS", 2)):
        monkeypatch.setattr(L, name, value)
    assert got(spark, docs, items) == expected  # many blocks, readings, pieces and batches
    assert got(spark, docs, items, 3) == brute(docs, [(i, t or "") for i, t in items], 3)
    assert got(spark, [(1, None)], items) == got(spark, docs, [(1, None)]) == []


def test_ties_go_by_id(spark):
    docs = [(i, "same text here") for i in range(100, 0, -1)] + [(200, "other words"), (201, "more other words")]
    assert [r[2] for r in sorted(got(spark, docs, [(1, "text")]), key=lambda r: r[1])] == list(range(1, 21))


def test_terms_are_the_pattern(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(L, "PIECE_BYTES", 7)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128), 0xA0, 0xDF, 0x130, 0x2028, 0x65E5])) for _ in range(60))
        assert [t.decode() for some in L.terms(text.encode()) for t in some] == plain_terms(text)


@pytest.mark.parametrize("mined", [4, 64])
def test_shared_sums_give_each_item_its_own(monkeypatch, mined):
    monkeypatch.setattr(L, "MINED", mined)
    rng = random.Random(mined)
    for _ in range(30):
        items = [set(rng.sample(range(40), rng.randrange(0, 25))) for _ in range(rng.randrange(1, 30))]
        items += items[:2]
        nodes, left = L.share(items, 40, list(range(40)))
        full = {s: Counter([s]) for s in range(40)}
        for i, parts in enumerate(nodes):
            assert all(p < 40 + i for p in parts)
            full[40 + i] = sum((full[p] for p in parts), Counter())
        assert [sum((full[s] for s in symbols), Counter()) for symbols in left] == [Counter(item) for item in items]


def test_sharing_saves_additions():
    rng = random.Random(1)
    phrases = [" ".join(f"p{i}x{j}" for j in range(8)) for i in range(10)]
    plan = L.mine([(i, (" ".join(rng.sample(phrases, 3)) + f" own{i}").encode()) for i in range(50)])
    apart = 50 * 25
    assert sum(map(len, plan.nodes)) + sum(len(s) for _, s in plan.items) < apart / 3
    scores = np.arange(len(plan.vocabulary) * 4).reshape(-1, 4)
    assert L.accumulate(plan, scores).shape == (50, 4)
