import random

from pyspark.sql import functions as F

from wayfarer.llm import toxicity as T


def corpus(spark):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    rows = []
    for i in range(600):
        text = rng.choices(words, k=rng.randint(20, 80))
        toxic = i % 3 == 0
        if toxic:
            for w in rng.sample(["vilefoo", "grimbar", "nastyqux"], rng.choice([1, 2])):
                text.insert(rng.randrange(len(text)), w)
        elif i % 30 == 1:
            text.insert(5, "vilefoo flower")  # a harmless phrase
        rows.append((i, " ".join(text), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_folding():
    assert T.fold("TR4SH​  Idі0t") == "trash idiot"
    assert T.bare(T.fold("ídïot")) == "idiot"


def test_lexicon_exceptions_and_edge_cases(spark):
    docs, labels = corpus(spark)
    lexicon = T.fit_from_tables(docs, labels)
    assert any(p.startswith("grim") for p in lexicon.weights) and any("vilefoo flower".startswith(e) or "flower" in e for e in lexicon.exceptions)
    extra = [(1, "so gr1mbar and nastyqux here"), (2, "a vilefoo flower blooms"), (3, None), (4, ""), (5, "calm words"), (None, "grimbar nastyqux"), (1, "so gr1mbar and nastyqux here")]
    df = spark.createDataFrame([(i, t, 9.0) for i, t in extra], "doc_id long, text string, score double")
    got = sorted(((r.doc_id or 0, r.score) for r in T.toxicity_scores(df, lexicon).collect()))
    by = dict(got)
    assert by[1] >= 0.5 and by[0] >= 0.5 and max(by[2], by[3], by[4], by[5]) < 0.5 and len(got) == 7
    kept = T.clean_documents(df, lexicon)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert T.toxicity_scores(df.where("false"), lexicon).count() == 0


def test_matches_begin_words_whatever_surrounds_them():
    """An exception that only occurs within a word doesn't hide a pattern of its own."""
    lexicon = T.Lexicon({"are": 2.0}, ["asses are fine"])
    found = lambda t: T.weight_of(T.fold(t), lexicon.automaton())[0]
    assert found("grasses are fine") == 2.0 and found("asses are fine") == 0.0 and found("\x01bare (aren't) care") == 2.0


def plain_weight(text, weights, exceptions):
    """Scan from the left: at each word start the longest pattern or exception that fits, then on behind it."""
    total, at = 0.0, 0
    while at < len(text):
        fits = [x for x in [*weights, *exceptions] if text.startswith(x, at)] if text[at].isalpha() and (at == 0 or not text[at - 1].isalpha()) else []
        if fits:
            best = max(fits, key=len)
            total += weights.get(best, 0.0)
            at += len(best)
        else:
            at += 1
    return total


def test_weights_match_a_plain_scan():
    rng = random.Random(6)
    words = ["ab", "abc", "ba", "b", "cab", "c", "abab", "a-b", "(ba"]
    for _ in range(300):
        weights = {w: rng.random() for w in rng.sample(["ab", "abc", "ba", "cab", "abab"], 3)}
        exceptions = [" ".join(rng.choices(["ab", "abc", "ba", "c"], k=2)) for _ in range(2)]
        text = " ".join(rng.choices(words, k=12))
        got = T.weight_of(text, T.Lexicon(weights, exceptions).automaton())[0]
        assert abs(got - plain_weight(text, weights, exceptions)) < 1e-9, (weights, exceptions, text)


def test_matches_at_the_end_of_a_text():
    found = lambda t: T.weight_of(T.fold(t), T.Lexicon({"idiot": 5.0}, ["old idiots", "idiot savants"]).automaton())[0]
    assert [found(x) for x in ("you old idiot", "you old idiot now", "old idiots", "idiot", "an idiot savant", "an idiot savants", "\x02idiot\x02")] == [5, 5, 0, 5, 5, 0, 5]
    rng = random.Random(7)
    for _ in range(3000):
        weights = {w: rng.random() for w in rng.sample(["ab", "abc", "ba", "cab", "abab"], 3)}
        exceptions = [" ".join(rng.choices(["ab", "abc", "ba", "c"], k=rng.randint(1, 3))) for _ in range(2)]
        weights = {w: x for w, x in weights.items() if w not in exceptions}
        text = " ".join(rng.choices(["ab", "abc", "ba", "b", "cab", "c"], k=rng.randint(1, 5)))
        got = T.weight_of(text, T.Lexicon(weights, exceptions).automaton())[0]
        assert abs(got - plain_weight(text, weights, exceptions)) < 1e-9, (weights, exceptions, text)


def test_scripts_without_spaces():
    found = lambda t: T.weight_of(T.fold(t), T.Lexicon({"傻逼": 3.0, "バカ": 2.0, "бля": 1.0}, ["傻逼花"]).automaton())[0]
    assert [found(x) for x in ("你是一个傻逼", "傻逼吗", "那个傻逼花", "このバカ", "облят", "бля")] == [3, 3, 0, 2, 0, 1]


def test_very_long_texts():
    lexicon = T.Lexicon({"idiot": 5.0}, [])
    assert T.weight_of(T.fold("calm idi0t " * 200_000), lexicon.automaton())[0] == 5.0 * 200_000


def test_stems_have_three_to_nine_letters():
    assert set(T.word_starts("ab abc abcdefghijk")) == {"abc", *("abcdefghijk"[:n] for n in range(3, 10))}


def test_training_rows_are_bounded_and_folded(spark):
    docs = spark.createDataFrame([(i % 50, f"Text{i} h3llo") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    rows = T.training_rows(docs, labels, 10).collect()
    assert len(rows) == 10 and all("hello" in r.text for r in rows)


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark)
    lexicon = T.fit_from_tables(docs, labels.where("toxic = 0"))
    assert not lexicon.weights
    assert T.toxicity_scores(docs, lexicon).agg(F.max("score")).first()[0] == 0


def test_copies_of_one_toxic_text_teach_little():
    """Words of copies share their rows; only a pattern that reaches more is kept."""
    pure = {f"copy{i}": 5.0 for i in range(40)} | {"real": 6.0}
    names = list(pure)
    rows = [list(range(40)) for _ in range(30)] + [[40] for _ in range(20)]
    for r in rows[:30]:
        r.append(40)
    assert list(T._choose(pure, rows, names)) == ["real"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = T.toxicity_scores(docs, T.fit_from_tables(docs, labels)).join(labels.where("toxic IS NOT NULL"), "doc_id")
    rows = scored.where(T.held_out(F.col("doc_id"))).collect()
    hit = sum(r.score >= 0.5 and r.toxic == 1 for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.85 and hit / sum(r.score >= 0.5 for r in rows) > 0.9
