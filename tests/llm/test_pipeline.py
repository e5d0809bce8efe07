"""The pipeline against a plain version of every stage."""

import public_tokenizers
import sentencepiece

import corpus_pipeline as P
from tests.llm.test_near_copies import groups
from wayfarer.llm import mixing, repeats, toxicity


def test_every_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    lexicon = toxicity.fit_from_tables(docs, labels)
    automaton = lexicon.automaton()
    value = lambda t: toxicity.density(*toxicity.weight_of(toxicity.fold(t), automaton), lexicon)
    clean = {i for i, r in rows.items() if value(r.text) < lexicon.cut}
    first = P.drop_toxic(spark, docs, sf)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == clean

    ids = sorted(clean)
    kept = {ids[i] for i, g in enumerate(groups([(i, rows[i].text) for i in ids])) if g == i}
    second = P.drop_near_copies(spark, first, sf)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == kept

    seen: set[bytes] = set()
    left = {}
    for i in sorted(kept):
        b = rows[i].text.encode()
        gone = [False] * len(b)
        own = [b[s : s + 50] for s in range(len(b) - 49)]
        for s, w in enumerate(own):
            if w in seen:
                gone[s : s + 50] = [True] * 50
        seen.update(own)
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone) or text.split():
            left[i] = text
    third = P.cut_repeats(spark, second, sf).cache()
    assert third.columns == docs.columns and {r.doc_id: r.text for r in third.collect()} == left

    copies = {r.doc_id: r.copies for r in mixing.mix(third).collect()}
    fourth = P.mix_sources(spark, third, sf)
    assert fourth.columns == docs.columns
    assert sorted(r.doc_id for r in fourth.collect()) == sorted(i for i, n in copies.items() for _ in range(n))

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in P.run(spark, sf).collect():
        assert list(r.ids) == library.encode(left[r.doc_id]) and r.round_trip
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeats", "mixing", "encoding"]
    assert repeats.WINDOW == 50
