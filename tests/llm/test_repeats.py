import hashlib
import random

import numpy as np

from wayfarer.llm import repeats as R


def brute(rows, window=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - window + 1):
            k = b[s : s + window]
            order = R.LAST if i is None else i
            first[k] = min(first.get(k, order), order)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < (R.LAST if i is None else i):
                gone[s : s + window] = [True] * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (x == 0 or not gone[x - 1]) for x, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df, **limits):
    return sorted((str(r.doc.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.sha256) for r in R.without_repeats(df, ["doc_id"], **limits).collect())


def corpus():
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "délta", "eps", "zeta.", "\n"]
    passages = [" ".join(rng.choices(words, k=40)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(3)]
        if i % 2:
            p = rng.choice(passages)
            a, b = sorted(rng.choices(range(len(p)), k=2))
            parts.insert(1, p[a:b])
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (3, rows[3][1]), (101, "a" * 400), (102, "a" * 300), (2, "a" * 120), (103, "ab" * 90), (104, "x" * 49), (105, "x" * 49), (106, None), (107, ""), (None, rows[5][1]), (None, passages[0])]
    return rows


def test_matches_brute_force_and_edge_cases(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, kept string")
    assert run(df) == brute(rows)
    assert run(df.repartition(3)) == brute(rows)
    assert run(df.where("false")) == []
    cleaned = R.cleaned_documents(df)
    assert cleaned.columns == df.columns
    left = {(r.doc_id, r.text) for r in cleaned.collect()}
    assert (106, None) in left and (107, "") in left and not any(i == 100 for i, _ in left)


def test_crowded_triggers_give_the_same(spark):
    """With tiny limits nearly every trigger is crowded and all windows are compared one by one."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, run_rows=1, slice_windows=1) == brute(rows)
    assert run(df, run_rows=3, slice_windows=40) == brute(rows)


def test_many_batches_and_slices(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run(df, run_rows=5, slice_windows=60) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_parse_does_not_depend_on_pieces(monkeypatch):
    data = " ".join(t or "" for _, t in corpus()).encode()
    whole = R.parse([data])
    place = lambda x: np.repeat(x[3], x[2] - x[1] + 1)  # the trigger of every window
    parts = R.parse([b"", data, b"short", data])
    assert (parts[0][: len(whole[0])] == 1).all() and (parts[0][len(whole[0]) :] == 3).all()
    assert all((np.concatenate((x, x)) == y).all() for x, y in zip(whole[1:], parts[1:], strict=True))
    monkeypatch.setattr(R, "PIECE", 700)
    cut = R.parse([data])
    assert (place(whole) == place(cut)).all()
    assert cut[1][0] == 0 and cut[2][-1] == len(data) - 50
