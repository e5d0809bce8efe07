"""Token counts of a byte-fallback BPE model by heap-and-linked-list merging (operator 4).

A text's symbols form a linked list; a heap holds the adjacent pairs that the vocabulary can merge. The pair of the
best score, leftmost among equals, is merged again and again. The count is the number of initial symbols less
the number of merges; no identifiers are made. A character without a piece counts as its UTF-8 bytes.

No piece has a space mark after another character, so no merge crosses the start of a word, and none crosses a
character without a piece. Words are therefore counted apart, and a bounded memo holds the counts of recent ones.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm._common import bounded_batches, table
from wayfarer.llm.piece_model import SPACE, PieceModel, read_model

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Words that a task remembers; the memo starts anew when it is full.
MEMO_WORDS = 300_000


def merge_count(symbols: str, scores: dict[str, float]) -> int:
    """Tokens left of ``symbols`` (one or more known characters) after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    piece: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (score := scores.get(symbols[i : i + 2])) is not None:
            heap.append((-score, i, i + 1, 2))
    heapq.heapify(heap)
    left = n
    while heap:
        _, a, b, size = heapq.heappop(heap)
        if piece[a] is None or piece[b] is None or after[a] != b or len(piece[a]) + len(piece[b]) != size:
            continue  # one side has been merged meanwhile
        piece[a] += piece[b]
        piece[b] = None
        left -= 1
        after[a] = after[b]
        if (c := after[a]) < n:
            before[c] = a
            if (score := scores.get(piece[a] + piece[c])) is not None:
                heapq.heappush(heap, (-score, a, c, len(piece[a]) + len(piece[c])))
        if (c := before[a]) >= 0 and (score := scores.get(piece[c] + piece[a])) is not None:
            heapq.heappush(heap, (-score, c, a, len(piece[c]) + len(piece[a])))
    return left


class TokenCounter:
    """Counts tokens of whole texts; equal to the length of the library's encoding without special tokens."""

    def __init__(self, model: PieceModel) -> None:
        if model.kind != "bpe":
            raise ValueError("a BPE model is needed")
        self.scores = {p: s for p, s in model.merge_scores.items()}
        self.known = {p for p in self.scores if len(p) == 1}
        self.words_apart = model.words_apart
        self.model = model
        self.memo: dict[str, int] = {}
        # With words apart, a unit is a run of space marks and what follows it; a line break ends a unit too.
        self.unit = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def _unit(self, unit: str) -> int:
        count, run = 0, []
        for c in unit:
            if c in self.known:
                run.append(c)
                continue
            count += merge_count("".join(run), self.scores) + len(c.encode())
            run.clear()
        return count + merge_count("".join(run), self.scores)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = self.model.normalise(text)
        if not self.words_apart:
            return self._unit(text)
        memo, total = self.memo, 0
        if SPACE + SPACE in text:
            # A run of marks may merge with the word behind it only by its last mark or as a whole piece.
            units = self.unit.findall(text)
        else:
            units = text.replace("\n", f"{SEPARATOR}\n{SEPARATOR}").replace(SPACE, SEPARATOR + SPACE).split(SEPARATOR)
        for unit in units:
            n = memo.get(unit)
            if n is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                n = self._unit(unit)
                if len(unit) <= 64:
                    memo[unit] = n
            total += n
        return total


#: A character that texts can't hold: a lone surrogate has no UTF-8 form.
SEPARATOR = "\udfff"


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(read_model(path))
        for batch in batches:
            counts = [counter.count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row; a null text counts as empty (0 tokens)."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return narrow.mapInArrow(_count(path), "doc_id long, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
