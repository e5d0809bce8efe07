"""A corpus pipeline of five of the training-data operators.

``documents`` go through toxicity filtering, near-duplicate removal, removal of repeated strings, mixing to the sources'
target weights and SentencePiece encoding. Each stage's result is written and read again by the next.

What holds for all stages: rows with null ids, texts or sources go through like others; texts are read whole, whatever their
length; repeated rows are rows of their own unless the stage is there to remove them; an empty table gives an empty one;
further columns are passed on by all stages but the last, also where their names are those the operators use (``n_chars`` is
counted anew where a text is cut).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfarer.llm import mixing, near_copies, pieces, repeats, toxicity
from wayfarer.llm._common import table
from wayfarer.session import ship_code, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled ones, rejects go.

    Null and empty texts score 0 and stay. Repeated rows score alike, so they stay or go together. Without labels nothing goes.
    """
    ship_code(spark)
    lexicon = toxicity.fit_from_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that of the smallest id.

    Exact copies are a group, and so are all null and empty texts together. Null ids come after all others; of rows that
    agree in id and text one stays.
    """
    ship_code(spark)
    return near_copies.keep_one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out.

    Documents are in order of their ids. A text of less than 50 bytes stays as it is and a null one stays null. A document
    that loses bytes and has no word left goes; one that never had a word stays.
    """
    ship_code(spark)
    return repeats.cleaned_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled and repeated until sources have their target weights.

    A null source is one of its own. Texts without words have no size; a source of such texts alone takes nothing. Rows that
    agree in id, source and text are taken as often as the mix says, the first of them in the order of a hash once more.
    """
    ship_code(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: ``doc_id, n_tokens, ids`` and the two checks; null and empty texts have none.

    Rows that the stage before has repeated are encoded each, and alike.
    """
    ship_code(spark)
    return pieces.encode_documents(docs, public_tokenizers.path(pieces.MODEL))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Several stages are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
