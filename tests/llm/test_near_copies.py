import itertools
import random

import pytest

from wayfarer.llm import near_copies as N
from wayfarer.operators.components import UnionFind


def shingles(text, k=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def groups(rows):
    """Smallest id of the group of each row, by comparing all pairs."""
    sets, cut = UnionFind(), [shingles(t) for _, t in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = cut[a] | cut[b]
        if not both or len(cut[a] & cut[b]) >= 0.8 * len(both):
            sets.union(a, b)
    return [sets.find(i) for i in range(len(rows))]


def corpus(seed, docs=40, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(docs):
        text = [rng.choice(vocabulary) for _ in range(words)]
        rows.append(" ".join(text))
        for _ in range(rng.randrange(4)):
            other = list(text)
            for _ in range(rng.randrange(1, 9)):
                other[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append(" ".join(other))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_groups_match_brute_force_and_edge_cases(spark):
    rows = corpus(4)
    top = len(rows)
    rows += [(top, None), (top + 1, ""), (top + 2, " \n"), (top + 3, "one two"), (top + 4, "One  TWO"), (top + 5, rows[0][1].upper()), (top + 6, "long " * 30_000)]
    df = spark.createDataFrame([(i, t, "x", 1, "z") for i, t in rows], "doc_id long, text string, fp string, id int, mark string")
    kept = N.keep_one_per_group(df)
    assert kept.columns == df.columns
    got, group = {r.doc_id for r in kept.collect()}, groups(rows)
    first = {i for i, g in enumerate(group) if g == i}
    assert first <= got  # no group is lost
    extra = len(got - first)
    assert extra <= 0.1 * (len(rows) - len(first))  # recall
    assert N.keep_one_per_group(df.where("false")).collect() == []


def test_one_row_of_every_group_stays_whatever_its_id(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]]  # stand alone, without an id
    rows += [(1, texts[4]), (1, texts[5]), (1, texts[5])]  # two groups of one id
    rows += [(2, texts[6]), (None, texts[6]), (3, texts[6]), (3, texts[7]), (None, texts[7])]  # a keeper's id in another group
    got = N.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, t) for t in texts[:4]] + [(1, texts[4]), (1, texts[5]), (2, texts[6]), (3, texts[7])]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_recall_on_documents(spark, table):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{table}/documents.parquet").collect())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, group = {r.doc_id for r in N.keep_one_per_group(df).collect()}, groups(rows)
    first = {rows[i][0] for i, g in enumerate(group) if g == i}
    assert first <= got
    assert len(got - first) <= 0.1 * (len(rows) - len(first))


def test_no_pair_is_left_out(spark, monkeypatch):
    """Short texts at 0.8 and a little more differ in more bits than fingerprints may; large groups are cut into slices."""
    monkeypatch.setattr(N, "GROUP_BOUND", 3, raising=False)
    monkeypatch.setattr(N, "COMMON", 3, raising=False)
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    texts, passage = [], words(30)
    for i in range(40):
        text = words(8 + i % 7)
        texts += [text, [*text, *words(1)]]  # at 4/5 and above
    for _ in range(12):  # one passage and own words, some of them alike
        text = passage + words(rng.randrange(1, 30))
        texts += [text, text[:-1] + words(1)]
    rows = list(enumerate(" ".join(t) for t in texts))
    got = {r.doc_id for r in N.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, g in enumerate(groups(rows)) if g == i}


def test_hashes_stand_for_shingles():
    for text in (None, "", " ", "a b", "a b c d e f a b c d e", "long " * 50, "A b\nC d e f G"):
        assert len(N.shingle_hashes((text or "").encode())) == len(N.shingle_set(text))
    assert set(N.shingle_hashes(b"a b c d e f g")) & set(N.shingle_hashes(b"x b c d e f y")) == set(N.shingle_hashes(b"b c d e f"))


def test_texts_travel_in_parts_and_only_for_pairs_that_can_be_alike(spark, monkeypatch):
    """A passage that all have is not enough to compare them; pairs whose texts are many go in parts, and none is lost."""
    monkeypatch.setattr(N, "PART_SHARE", 0.2, raising=False)
    monkeypatch.setattr(N, "COMMON", 1 << 30, raising=False)
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, texts = words(12), []
    for _ in range(40):
        text = passage + words(60)
        texts += [text, text[:-1] + words(1)]
    rows, tables = list(enumerate(" ".join(t) for t in texts)), {}
    plain = N.written

    def seen(df, name):
        tables.setdefault(name, []).append(plain(df, name))
        return tables[name][-1]

    monkeypatch.setattr(N, "written", seen)
    got = {r.doc_id for r in N.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, g in enumerate(groups(rows)) if g == i}
    met, compared = tables["near-prefix-pairs"][0].count(), tables["near-enough"][0].count()
    assert compared <= 80 < met
    assert len(tables["near-links"]) > 4


def test_copies_that_are_not_near_enough_are_not_compared(spark, monkeypatch):
    """Copies of one text with too many words changed to be alike share most shingles; only pairs that can be alike meet."""
    monkeypatch.setattr(N, "MANY", 20, raising=False)
    rng = random.Random(3)
    words = [f"w{rng.randrange(4000)}" for _ in range(300)]
    texts = []
    for _ in range(60):
        text = list(words)
        for at in rng.sample(range(300), 7):
            text[at] = f"x{rng.randrange(10**9)}"
        texts.append(text)
    texts += [[*text[:-1], "last"] for text in texts[:20]]
    rows, tables, plain = list(enumerate(" ".join(t) for t in texts)), {}, N.written
    monkeypatch.setattr(N, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    classes = spark.createDataFrame([(i, i) for i in range(80)], "id long, d long").withColumns({"h1": N.F.lit(1).cast("long"), "h2": N.F.lit(2).cast("long")})
    docs = spark.createDataFrame(rows, "d long, text string").withColumns({"h1": N.F.lit(1).cast("long"), "h2": N.F.lit(2).cast("long")})
    got = {(r.a, r.b) for r in N.missing_links(classes, docs, spark.createDataFrame([], "id long, root long")).collect()}
    cut = [shingles(t) for _, t in rows]
    assert got == {(a, b) for a, b in itertools.combinations(range(80), 2) if len(cut[a] & cut[b]) >= 0.8 * len(cut[a] | cut[b])}
    assert len(got) <= tables["near-enough"].count() <= tables["near-prefix-pairs"].count() <= 2 * len(got) + 80  # 3,160 pairs share a shingle


def test_common_shingles_are_counted_one_by_one(spark, monkeypatch):
    """A shingle that eight texts have is told from rare ones, however many of those there are."""
    monkeypatch.setattr(N, "COUNTED_BYTES", 1000, raising=False)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) + (" a passage that some of them have" if i % 5 == 0 else "") for i in range(50)]
    hashes, counts = N.shingle_ranks(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string"))
    want = set(N.shingle_hashes(b"a passage that some of them have").tolist())
    assert set(hashes.tolist()) == want and set(counts.tolist()) == {10}
    assert N._ranked(N.shingle_hashes(texts[0].encode()), (hashes, counts)).sum() == 10 * len(want)


def test_parities_bound_the_difference():
    rng = random.Random(2)
    draw = lambda n: N.np.array(sorted({rng.getrandbits(64) for _ in range(n)}), N.np.uint64)
    for common, a, b in ((300, 10, 5), (0, 3, 0), (2000, 200, 400), (0, 0, 0)):
        both = draw(common)
        x, y = (N._parities(N.np.concatenate([both, draw(n)])) for n in (a, b))
        differ = sum((int(i) ^ int(j)).bit_count() for i, j in zip(x.view("uint64"), y.view("uint64")))
        assert differ <= a + b and (a + b > 20 or differ >= a + b - 4)
