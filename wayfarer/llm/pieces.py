"""SentencePiece encoding and decoding with the tokenizers library as backend (operator 8).

The model file's protobuf is parsed and the tokenizer rebuilt from it: normaliser, space mark, byte fallback, and
either the unigram scores or, for a BPE model such as the one at hand, the merges that its scores imply (every split of a
piece into two pieces, in the order of the joined piece's score). Batches are encoded by the library's threads.

Pieces that consist of space marks alone share one score, the lowest, so they are joined last and the leftmost pair first.
A list of merges can't say that: it leaves runs of single marks, which :func:`mark_run` joins by their length.

Parity: every row is encoded by the sentencepiece library as well. Where the two differ, ``parity`` is false and the
library's ids are taken. A caller may ask for one row in ``parity_every`` by hash of id and text. Decoding returns the
text; ``round_trip`` tells whether it is the input.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from wayfarer.llm._common import bounded_batches, table
from wayfarer.llm.piece_model import BYTE, NORMAL, SPACE, UNKNOWN, UNUSED, USER_DEFINED, PieceModel, read_model

MODEL = "piece_bpe_32k.model"
#: Characters that the library gets at a time, longer words and texts apart.
CALL_CHARS = 1 << 18
#: Words that are put into one text.
LINE_WORDS = 256
#: Words that a task remembers, and the longest of them.
MEMO_WORDS, MEMO_CHARS = 1 << 18, 48
PARITY_EVERY = 1
THREADS = 2


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """The merges of a BPE model, best first."""
    apart = mark_lengths(model)
    rank = {p: (i, s) for i, (p, s, t) in enumerate(model.pieces) if t in (NORMAL, UNUSED, USER_DEFINED)}
    found = []
    for piece, (_, score) in rank.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in rank and right in rank and not (apart and not piece.strip(SPACE)):
                found.append((-score, rank[left][0], rank[right][0], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def mark_lengths(model: PieceModel) -> dict[int, int]:
    """Ids of the pieces made of space marks alone by their length, where they share the lowest score; else empty."""
    normal = [(i, p, s) for i, (p, s, t) in enumerate(model.pieces) if t == NORMAL]
    marks = [(i, p, s) for i, p, s in normal if p and not p.strip(SPACE)]
    low = min((s for *_, s in marks), default=0.0)
    alone = model.kind == "bpe" and len(marks) > 1 and {s for *_, s in marks} == {low} and not any(s <= low for _, p, s in normal if p.strip(SPACE))
    return {len(p): i for i, p, _ in marks} if alone else {}


def mark_run(n: int, lengths: dict[int, int]) -> list[int]:
    """Ids of ``n`` marks in a row: the leftmost two neighbours that make a piece are joined, again and again."""
    done: list[int] = []  # no two neighbours of these make a piece
    for _ in range(n):
        done.append(1)
        while len(done) > 1 and done[-2] + done[-1] in lengths:
            last = done.pop()
            done[-1] += last
    return [lengths[k] for k in done]


def build_tokenizer(model: PieceModel) -> Tokenizer:
    unknown = model.pieces[model.unk_id][0]
    if model.kind == "bpe":
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab=vocabulary, merges=merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == "unigram":
        # Pieces that texts don't match by themselves get a score that never wins.
        low = min(s for _, s, _ in model.pieces) - 100
        scores = [(p, s if t in (NORMAL, USER_DEFINED) else low) for p, s, t in model.pieces]
        core = models.Unigram(vocab=scores, unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"models of kind {model.kind} are not supported")
    rules: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        rules += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        rules.append(normalizers.Prepend(" "))
    if model.escape_whitespaces:
        rules.append(normalizers.Replace(" ", SPACE))
    tokenizer = Tokenizer(core)
    if rules:
        tokenizer.normalizer = normalizers.Sequence(rules)
    steps: list = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.add_dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(steps)
    return tokenizer


class PieceCodec:
    """Encodes and decodes batches of whole texts."""

    def __init__(self, model: PieceModel, threads: int = THREADS) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = model
        self.tokenizer = build_tokenizer(model)
        self.marks = mark_lengths(model)
        self.runs: dict[int, list[int]] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.by_word = model.words_apart and model.add_dummy_prefix and not model.remove_extra_whitespaces and not model.charsmap and 1 in self.marks
        self.line_break = next((i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE and p == "<0x0A>"), None)
        # Bytes of the pieces that spell themselves; of byte pieces the byte they stand for.
        plain = {i: p.encode() for i, (p, _, t) in enumerate(model.pieces) if t == NORMAL} | {i: bytes([int(p[1:-1], 16)]) for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.bytes_of = plain if model.add_dummy_prefix and model.escape_whitespaces else None

    def _joined(self, ids: list[int]) -> list[int]:
        """``ids`` with runs of single marks joined."""
        mark = self.marks.get(1)
        if mark is None or mark not in ids:
            return ids
        out: list[int] = []
        at = 0
        while at < len(ids):
            end = at
            while end < len(ids) and ids[end] == mark:
                end += 1
            if end > at:
                n = end - at
                if n not in self.runs and n <= 4096:
                    self.runs[n] = mark_run(n, self.marks)
                out += self.runs[n] if n <= 4096 else mark_run(n, self.marks)
            try:
                at = ids.index(mark, end)
            except ValueError:
                at = len(ids)
            out += ids[end:at]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text.

        Where pieces keep to words, the library gets each word of the batch once, with the mark before it, and what it said
        of a word is remembered; else it gets whole texts. Either way it gets a bounded number of characters at a time.
        """
        if not self.by_word:
            return [self._joined(ids) for ids in self._library(texts)]
        cut = [text.split(" ") if text else [] for text in texts]
        known = self.memo
        asked = list(set().union(*cut) - known.keys() - {""})
        known.update(zip(asked, self._words(asked), strict=True))
        known[""] = (self.marks[1],)
        out = [self._joined(list(chain.from_iterable(map(known.__getitem__, words)))) for words in cut]
        if len(known) > MEMO_WORDS:
            known.clear()
        elif any(len(w) > MEMO_CHARS for w in asked):
            for w in asked:
                if len(w) > MEMO_CHARS:
                    del known[w]
        return out

    def _words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words, many in one text: no piece holds a line break, so its byte's id parts them again."""
        if self.line_break is None:
            return [tuple(ids) for ids in self._library(words)]
        plain, broken = [w for w in words if "\n" not in w], [w for w in words if "\n" in w]
        lines = [plain[i : i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        out: dict[str, tuple[int, ...]] = {}
        for line, ids in zip(lines, self._library(["\n ".join(line) for line in lines]), strict=True):
            at, ids = 0, (*ids, self.line_break)
            for w in line:
                end = ids.index(self.line_break, at)
                out[w] = ids[at:end]
                at = end + 1
        out.update((w, tuple(ids)) for w, ids in zip(broken, self._library(broken), strict=True))
        return [out[w] for w in words]

    def _library(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < CALL_CHARS:
                size += len(texts[end])
                end += 1
            out += [found.ids for found in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def spelled(self, ids: list[int]) -> str | None:
        """The text of ids by their pieces alone; ``None`` where their bytes are no text, or the model has other rules."""
        if self.bytes_of is None:
            return None
        try:
            text = b"".join([self.bytes_of[i] for i in ids]).decode()
        except (UnicodeDecodeError, KeyError):
            return None
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


_ENCODED = "doc_id long, n_tokens long, ids array<int>, round_trip boolean, parity_checked boolean, parity boolean"


def _encode(path: str, threads: int, parity_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        codec = PieceCodec(read_model(path), threads)
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            check = np.mod(batch.column("h").to_numpy(), parity_every) == 0
            for at in range(0, len(texts), 256):
                some = texts[at : at + 256]
                ids = codec.encode(some)
                parity: list[bool | None] = [None] * len(some)
                for i in np.flatnonzero(check[at : at + 256]).tolist():
                    own = library.encode(some[i])
                    parity[i] = ids[i] == own
                    ids[i] = own
                # Ids whose pieces spell the text decode to it; the others are decoded.
                same = [codec.spelled(x) == t for x, t in zip(ids, some, strict=True)]
                for i in (i for i, ok in enumerate(same) if not ok):
                    same[i] = codec.decode([ids[i]])[0] == some[i]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                values = np.fromiter((x for row in ids for x in row), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at : at + 256], pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(same), pa.array(check[at : at + 256]), pa.array(parity, pa.bool_())],
                    [c.split()[0] for c in _ENCODED.split(", ")],
                )

    return run


def encode_documents(docs: DataFrame, path: str, threads: int = THREADS, parity_every: int = PARITY_EVERY) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip, parity_checked, parity`` for every row of ``docs``.

    ``parity`` is null for a row that isn't checked. A null text counts as empty: no ids. Whole texts of any length are
    encoded. Repeated rows are encoded alike, an empty table gives no rows, and other
    columns are not read. Begin, end and special tokens are never added, and their strings in a text are text.
    """
    bounded_batches(docs.sparkSession, 4 << 20)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), "text")
    return narrow.mapInArrow(_encode(path, threads, parity_every), _ENCODED)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``.

    Null ids give a null text, no ids an empty one; texts may be of any length. Repeated rows are decoded alike, an empty
    table gives no rows, and other columns (a ``text`` among them) are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(read_model(path))
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            decoded = codec.decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else t for x, t in zip(ids, decoded, strict=True)], pa.string())], ["doc_id", "text"])

    bounded_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
