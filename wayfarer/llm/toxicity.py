"""Toxicity by a weighted lexicon (operator 2).

Texts are folded (case, look-alike letters, digits for letters, invisible characters; accents too in a second
reading) and matched by one Aho-Corasick automaton of word-initial patterns and exception phrases; a match inside an
exception phrase doesn't count. A pattern weighs the log of its rate among toxic words over that among clean ones.
The weights of the matches are summed and divided by a power of the text's length; ``score = x / (x + t)`` puts the
learned cut ``t`` at 0.5.

The lexicon is learned from at most ``TRAIN_ROWS`` labelled rows (those of the lowest hash), folded once; scoring covers
every row and every whole text. Patterns are stems: initial pieces of ``SHORTEST`` to ``LONGEST`` letters, so that a word's
inflected and compound forms count alike; there is no bound on their number or on that of the exception phrases.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm._common import bounded_batches, per_batch, table, texts
from wayfarer.session import written

#: Bound on the labelled rows that the lexicon is fitted on.
TRAIN_ROWS = 20_000
MIN_SUPPORT = 4
MIN_PURITY = 0.9
#: Log ratio of rates from which a pattern stands on its own.
OWN_WEIGHT = 3.5
SHORTEST, LONGEST = 3, 9
#: Marks the start of a word, in texts and in patterns: a match can't begin within a word.
START = "\x01"
#: Ends a text, so that a match at its end is reported though a longer pattern might have gone on.
END = "\x02"

# Letters of other alphabets and small capitals that look like Latin ones, and the usual substitutions.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ø": "o", "đ": "d", "ħ": "h", "ł": "l", "ŧ": "t",
    "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ꜰ": "f", "ɢ": "g", "ʜ": "h", "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ʟ": "l", "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ʏ": "y", "ᴢ": "z",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "£": "l", "¥": "y"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_FOLD = {ord(k): v for k, v in (LOOKALIKES | DIGITS).items()} | {ord(c): None for c in INVISIBLE + START + END}
_FOLD_ASCII = {ord(k): v for k, v in DIGITS.items()} | {ord(START): None, ord(END): None}
_ACCENTS = dict.fromkeys(range(0x300, 0x370))
_WORD = re.compile(r"[^\W\d_]+")
# Letters of scripts that put no spaces between words (Thai to Burmese, Khmer, kana, Han) each may begin one.
_WORD_START = re.compile("(?<![^\\W\\d_])(?=[^\\W\\d_])|(?=[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff])")


def fold(text: str) -> str:
    """Lower-case text without disguises, words apart by single spaces."""
    if text.isascii():
        return " ".join(text.lower().translate(_FOLD_ASCII).split())
    return " ".join(unicodedata.normalize("NFKC", text).lower().translate(_FOLD).split())


def bare(folded: str) -> str:
    """A folded text without accents."""
    return folded if folded.isascii() else unicodedata.normalize("NFKD", folded).translate(_ACCENTS)


def marked(folded: str) -> str:
    """A folded text with the starts of its words marked."""
    return _WORD_START.sub(START, folded)


def word_starts(folded: str) -> Counter:
    """How often each initial piece of the text's words occurs."""
    counts: Counter = Counter()
    for w, n in Counter(_WORD.findall(folded)).items():
        for size in range(SHORTEST, min(len(w), LONGEST) + 1):
            counts[w[:size]] += n
    return counts


@dataclass
class Lexicon:
    """What is learned: pattern weights, exception phrases, the law of the length and the cut."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    exponent: float = 0.5
    scale: float = 100.0
    cut: float = 1.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            found.add_word(marked(pattern), (len(marked(pattern)), weight))
        for phrase in self.exceptions:
            found.add_word(marked(phrase), (len(marked(phrase)), 0.0))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matches(text: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the leftmost longest matches in a marked text, all of which begin a word."""
    return [(last - length + 1, last + 1, weight) for last, (length, weight) in automaton.iter_long(text + END)]


def weight_of(folded: str, automaton) -> tuple[float, int]:
    """Sum of the weights and number of words."""
    if automaton is None:
        return 0.0, folded.count(" ") + 1
    readings = {folded, bare(folded)}
    total = max(sum(w for _, _, w in matches(marked(x), automaton)) for x in readings)
    return total, folded.count(" ") + 1


def density(total: float, n_words: int, lexicon: Lexicon) -> float:
    return total / (1 + n_words / lexicon.scale) ** lexicon.exponent


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic``: at most ``rows`` labelled rows outside the held-out fold, those of the lowest hash; texts folded.

    Of documents that share an id the one of the smallest text counts, so that the bound holds for rows, too.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # bounded: `rows` pairs of numbers
    found = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    once = found.groupBy("_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return once.select("text", "toxic").mapInArrow(per_batch(_fold_rows), "text string, toxic int")


def _fold_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fold(t) for t in texts(batch, "text")], pa.string()), batch.column("toxic")], ["text", "toxic"])


def _starts(candidates: frozenset[str] | None):
    """Occurrences and rows of word starts; the row without pattern counts all words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, rows = Counter(), Counter()
        words = 0
        for folded in texts(batch, "text"):
            words += folded.count(" ") + 1
            found = word_starts(folded)
            if candidates is not None:
                found = {p: found[p] for p in found.keys() & candidates}
            tokens.update(found)
            rows.update(found.keys())
        names = list(tokens)
        return pa.RecordBatch.from_arrays([pa.array([None, *names], pa.string()), pa.array([words, *(tokens[p] for p in names)], pa.int64()), pa.array([batch.num_rows, *(rows[p] for p in names)], pa.int64())], ["pattern", "tokens", "rows"])

    return per_batch(run)


def _which_starts(candidates: dict[str, int]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [sorted(candidates[p] for p in word_starts(t) if p in candidates) for t in texts(batch, "text")]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["ids"])

    return per_batch(run)


def _neighbours(lexicon: Lexicon):
    """Two-word phrases around matches, with the rows of either label that hold them. Texts are cut at spaces."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, counts = lexicon.automaton(), {0: Counter(), 1: Counter()}
        for text, toxic in zip(texts(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
            found, seen = marked(text), set()
            for start, end, _ in matches(found, automaton):
                end = (found.find(" ", end) + 1 or len(found) + 1) - 1
                before, after = found.rfind(" ", 0, max(0, start - 1)) + 1, found.find(" ", end + 1)
                seen.add(found[before:end].replace(START, ""))
                seen.add(found[start : after if after >= 0 else len(found)].replace(START, ""))
            counts[int(toxic > 0)].update(p for p in seen if " " in p and _WORD_START.match(p))
        names = list(counts[0])  # only phrases of clean rows can be exceptions
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[0][p] for p in names], pa.int64()), pa.array([counts[1][p] for p in names], pa.int64())], ["phrase", "clean", "toxic"])

    return per_batch(run)


def _totals(lexicon: Lexicon):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = lexicon.automaton()
        both = [weight_of(t, automaton) for t in texts(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array([x for x, _ in both], pa.float64()), pa.array([n for _, n in both], pa.int64())], ["toxic", "total", "words"])

    return per_batch(run)


def _choose(pure: dict[str, float], toxic_rows: list[list[int]], names: list[str]) -> dict[str, float]:
    """Pure patterns, widest first, leaving out those that only tell copies of one toxic text apart.

    All words of such a text occur in the same rows. A pattern stays if few others share its rows, or if it reaches
    toxic rows that hardly any chosen pattern does.
    """
    holders: dict[str, set[int]] = {name: set() for name in pure}
    for row, ids in enumerate(toxic_rows):
        for i in ids:
            if names[i] in holders:
                holders[names[i]].add(row)
    alike = Counter(frozenset(rows) for rows in holders.values())
    chosen: dict[str, float] = {}
    covered: Counter = Counter()
    for name in sorted(pure, key=lambda p: (-len(holders[p]) * pure[p], len(p), p)):
        if any(name[:n] in chosen for n in range(SHORTEST, len(name))) or any(c.startswith(name) for c in chosen):
            continue
        # The longest start that keeps nearly all the rows says most precisely what is meant.
        longer = [p for p in holders if p.startswith(name) and len(holders[p] & holders[name]) >= 0.9 * len(holders[name])]
        name = max(longer, key=lambda p: (len(p), p))
        fresh = sum(not covered[r] for r in holders[name])
        own = alike[frozenset(holders[name])] <= LONGEST + 3 and len(holders[name]) >= 3 * MIN_SUPPORT and pure[name] >= OWN_WEIGHT
        if own or fresh >= MIN_SUPPORT and fresh >= 0.05 * len(holders[name]):
            chosen[name] = pure[name]
            covered.update(holders[name])
    return chosen


def fit_lexicon(train: DataFrame) -> Lexicon:
    """Learn from a bounded ``train`` (folded ``text, toxic``); without rows of both labels nothing is ever toxic."""
    n = {int(r["y"]): r["n"] for r in train.groupBy((F.col("toxic") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon()
    bad, good = train.where("toxic > 0"), train.where("toxic <= 0")
    kind = "pattern string, tokens long, rows long"
    summed = lambda rows: rows.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))
    starts = summed(bad.select("text").mapInArrow(_starts(None), kind)).where(F.col("rows") >= MIN_SUPPORT)
    frequent = {r["pattern"]: r["tokens"] for r in starts.collect()}
    toxic_words = frequent.pop(None, 1)
    clean = {r["pattern"]: r["tokens"] for r in summed(good.select("text").mapInArrow(_starts(frozenset(frequent)), kind)).collect()}
    clean_words = clean.pop(None, 1)
    pure = {}
    for pattern, tokens in frequent.items():
        a, b = (tokens + 0.5) / toxic_words, (clean.get(pattern, 0) + 0.5) / clean_words
        if a / (a + b) >= MIN_PURITY:
            pure[pattern] = math.log(a / b)
    likely = list(pure)
    rows = [r["ids"] for r in bad.select("text").mapInArrow(_which_starts({p: i for i, p in enumerate(likely)}), "ids array<int>").collect()]
    lexicon = Lexicon(_choose(pure, rows, likely))
    if not lexicon.weights:
        return lexicon
    phrases = train.mapInArrow(_neighbours(lexicon), "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    phrases = phrases.where((F.col("clean") >= 3) & (F.col("clean") > 4 * F.col("toxic")))
    lexicon.exceptions = sorted(r["phrase"] for r in phrases.collect())
    got = train.mapInArrow(_totals(lexicon), "toxic int, total double, words long").toPandas()
    _set_cut(lexicon, got["total"].to_numpy(), got["words"].to_numpy(), got["toxic"].to_numpy() > 0)
    return lexicon


def _set_cut(lexicon: Lexicon, total: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> None:
    """The law of the length and the cut of the best F1 on the training rows; the cut lies midway between scores."""
    best = -1.0
    for scale, exponent in itertools.product((10.0, 30.0, 100.0, 300.0), (0.25, 0.5, 0.75, 1.0)):
        x = total / (1 + words / scale) ** exponent
        order = np.argsort(-x, kind="stable")
        hits = np.cumsum(toxic[order])
        f1 = 2 * hits / (np.arange(1, len(x) + 1) + toxic.sum())
        value = x[order]
        last = np.append(value[1:] < value[:-1], True) & (value > 0)  # cuts fall between different values only
        if last.any():
            at = int(np.argmax(np.where(last, f1, -1)))
            below = value[at + 1] if at + 1 < len(value) else 0.0
            if f1[at] > best + 1e-9:
                best = float(f1[at])
                lexicon.exponent, lexicon.scale, lexicon.cut = exponent, scale, float((value[at] + max(below, 0.0)) / 2) or 1.0


def _scores(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()  # built once per task; only the lexicon is shipped
        for batch in batches:
            x = [max(0.0, density(*weight_of(fold(t), automaton), lexicon)) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([v / (v + lexicon.cut) for v in x], pa.float64())], ["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score`` for every row.

    Null and empty texts score 0, repeated rows score alike, very long texts count as a whole, null ids stay null, other
    columns are not read, and an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(lexicon), "doc_id long, score double")


def clean_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs``, columns as they are, that score below 0.5: null and empty texts stay, and repeated rows
    stay or go together. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = [density(*weight_of(fold(t), automaton), lexicon) for t in texts(batch, "text")]
            yield batch.filter(pa.array([max(v, 0.0) / (max(v, 0.0) + lexicon.cut) < 0.5 for v in x], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def fit_from_tables(docs: DataFrame, labels: DataFrame) -> Lexicon:
    bounded_batches(docs.sparkSession)
    return fit_lexicon(written(training_rows(docs, labels), "toxicity-train"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, fit_from_tables(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
