"""Ranked lexical search of many queries at once, by sharing their common parts (operator 13).

The items are cut into blocks. For each block a task mines the sets of terms that items share: terms held by exactly the
same items become one node, then the pair of nodes that most items share becomes a node, again and again. What comes out
is a graph in which each node is a sum of earlier ones and each item a sum of a few nodes.

Documents are read twice, by tasks of their own. The first reading counts what the weights need. In the second one a
task turns a batch of documents into one row of scores for each term, computes each node of the graph once as a partial
accumulator over the batch, and adds up the items from the nodes. A task keeps the best documents of each item, and the
lists of all tasks are merged by Spark in two steps. No pair of an item and a document is ever shuffled.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.llm._common import bounded_batches, raw_bytes, table
from wayfarer.session import written

K = 20
#: Items of a block, which one task mines.
BLOCK_ITEMS = 256
#: Terms and nodes that one reading of the documents takes; more items take more readings.
PASS_SYMBOLS = 1 << 16
#: Nodes of an item among which pairs are sought; more are dealt into groups of this size by a hash of the term.
MINED = 64
#: Numbers of one matrix of a batch.
CELLS = 1 << 21
#: A longer text is cut into terms piece by piece.
PIECE_BYTES = 1 << 20
MERGE_WAYS = 64

# Terms are runs of ASCII letters, ASCII digits and all bytes beyond ASCII; only A to Z are lower-cased.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces of bounded size."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = at + PIECE_BYTES
        if end < len(folded):
            end = folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


# --- what items share ---


def share(items: list[set[int]], symbols: int, groups: list[int] | None = None) -> tuple[list[list[int]], list[list[int]]]:
    """Sums that items (sets of symbols below ``symbols``) share: nodes as lists of earlier symbols, and items as lists of symbols.

    Node i is symbol ``symbols + i``. ``groups`` are numbers by which the symbols of a long item are kept apart.
    """
    nodes: list[list[int]] = []
    holders: dict[int, int] = defaultdict(int)  # items of a symbol, as bits
    for i, item in enumerate(items):
        for s in item:
            holders[s] |= 1 << i
    left = [set(item) for item in items]

    def replace(parts: list[int], bits: int) -> int:
        new = symbols + len(nodes)
        nodes.append(parts)
        holders[new] = bits
        while bits:
            low = bits & -bits
            i = low.bit_length() - 1
            left[i].difference_update(parts)
            left[i].add(new)
            bits ^= low
        return new

    alike: dict[int, list[int]] = defaultdict(list)
    for s, bits in sorted(holders.items()):
        alike[bits].append(s)
    group = dict(enumerate(groups)) if groups else {}
    for bits, together in alike.items():
        if len(together) > 1 and bits.bit_count() > 1:
            new = replace(together, bits)
            group[new] = group.get(together[0], 0)
            for s in together:
                holders[s] &= ~bits
    counts: Counter = Counter()
    for item in left:
        shared = sorted(s for s in item if holders[s].bit_count() > 1)
        ways = -(-len(shared) // MINED)
        dealt: dict[int, list[int]] = defaultdict(list)
        for s in shared:
            dealt[group.get(s, 0) % ways].append(s)
        for some in dealt.values():
            for at in range(0, len(some), MINED):  # a hash deals unevenly
                part = some[at : at + MINED]
                counts.update((a, b) for x, a in enumerate(part) for b in part[x + 1 :])
    heap = [(-n, pair) for pair, n in counts.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        bits = holders[a] & holders[b]
        now = bits.bit_count()
        if now < 2:
            continue
        if now < -n:  # items have used a or b otherwise since
            heapq.heappush(heap, (-now, (a, b)))
            continue
        new = replace([a, b], bits)
        holders[a] &= ~bits
        holders[b] &= ~bits
        beside: Counter = Counter()
        while bits:
            low = bits & -bits
            item = left[low.bit_length() - 1]
            if len(item) <= 4 * MINED:
                beside.update(s for s in item if s != new)
            bits ^= low
        for s, n in beside.items():
            if n > 1:
                heapq.heappush(heap, (-n, (s, new)))
    return nodes, [sorted(item) for item in left]


@dataclass
class Plan:
    """Terms, atoms (a term so many times), nodes and items of one reading."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    atoms: list[tuple[int, int]] = field(default_factory=list)
    nodes: list[list[int]] = field(default_factory=list)
    items: list[tuple[int | None, list[int]]] = field(default_factory=list)

    @property
    def symbols(self) -> int:
        return len(self.atoms) + len(self.nodes)


def mine(items: list[tuple[int | None, bytes]]) -> Plan:
    """The plan of a block of items (id, text)."""
    plan, atoms, sets = Plan(), {}, []
    for _, text in items:
        counts: Counter = Counter()
        for some in terms(text):
            counts.update(some)
        sets.append({atoms.setdefault((plan.vocabulary.setdefault(t, len(plan.vocabulary)), n), len(atoms)) for t, n in counts.items()})
    plan.atoms = list(atoms)
    plan.nodes, left = share(sets, len(atoms), [t for t, _ in plan.atoms])
    plan.items = [(i, symbols) for (i, _), symbols in zip(items, left, strict=True)]
    return plan


def joined(plans: list[Plan]) -> Plan:
    """One plan of several; terms that they share are one row of scores."""
    out = Plan()
    for p in plans:
        names = [out.vocabulary.setdefault(t, len(out.vocabulary)) for t in p.vocabulary]
        out.atoms += [(names[t], n) for t, n in p.atoms]
    at_atom, at_node = 0, len(out.atoms)
    for p in plans:
        own = len(p.atoms)
        moved = lambda symbols: [s + at_atom if s < own else s - own + at_node for s in symbols]  # noqa: B023, E731
        out.nodes += [moved(parts) for parts in p.nodes]
        out.items += [(i, moved(symbols)) for i, symbols in p.items]
        at_atom, at_node = at_atom + own, at_node + len(p.nodes)
    return out


def accumulate(plan: Plan, scores: np.ndarray) -> np.ndarray:
    """Scores of items by documents from those of terms by documents: each node once, then the items."""
    made = np.empty((plan.symbols, scores.shape[1]), np.int64)
    if plan.atoms:
        of, times = np.array(plan.atoms, np.int64).T
        np.multiply(scores[of], times[:, None], out=made[: len(plan.atoms)])
    for i, parts in enumerate(plan.nodes, len(plan.atoms)):
        np.add.reduce(made[parts], axis=0, out=made[i])
    return np.stack([made[symbols].sum(axis=0) for _, symbols in plan.items])


# --- documents ---


def _counted(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (documents by terms) and the number of all terms of each document."""
    width, flat, lengths = len(vocabulary), [], np.zeros(len(texts), np.int64)
    get = vocabulary.get
    for d, text in enumerate(texts):
        for some in terms(text):
            lengths[d] += len(some)
            known = np.fromiter((t for t in map(get, some) if t is not None), np.int64)
            flat.append(known + d * width)
    found = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    return np.bincount(found, minlength=len(texts) * width).reshape(len(texts), width), lengths


def _few(width: int, batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, as many at a time as their matrix may have rows."""
    at_most = max(8, CELLS // max(1, width))
    for at in range(0, batch.num_rows, at_most):
        yield at, raw_bytes(batch.column("text").slice(at, at_most))


def _statistics(vocabulary: dict[bytes, int]):
    """Rows (term, documents) of a task; term -1 has the number of documents with terms, -2 that of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for _, texts in _few(len(vocabulary), batch):
                counts, lengths = _counted(texts, vocabulary)
                df += (counts > 0).sum(axis=0)
                n += int((lengths > 0).sum())
                total += int(lengths.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((seen, [-1, -2])).astype(np.int64)), pa.array(np.concatenate((df[seen], [n, total])).astype(np.int64))], ["term", "n"])

    return run


class Best:
    """The k best documents of each item so far; equal scores by id, documents without an id last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.bar = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]  # item, score, id, id is null

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        if not scores.size:
            return
        bar = self.bar
        if scores.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        item, doc = np.nonzero(scores >= bar[:, None])
        if not len(item):
            return
        new = [item, scores[item, doc], ids[doc], missing[doc]]
        item, score, name, null = (np.concatenate(x) for x in zip(self.rows, new, strict=True))
        order = np.lexsort((name, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = order[place < self.k]
        self.rows = [np.concatenate(x)[keep] for x in zip(self.rows, new, strict=True)]
        full = place == self.k - 1
        self.bar[item[full]] = score[order][full]


def _search(plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, width = Best(len(plan.items), k), len(plan.vocabulary)
        for batch in batches:
            column = batch.column("doc_id")
            missing = column.is_null().to_numpy(zero_copy_only=False)
            ids = column.fill_null(0).to_numpy()
            for at, texts in _few(max(width, plan.symbols, len(plan.items)), batch):
                counts, lengths = _counted(texts, plan.vocabulary)
                norm = np.array([75 + 25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
                doc, term = np.nonzero(counts)
                tf = counts[doc, term]
                scores = np.zeros((width, len(texts)), np.int64)
                scores[term, doc] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * norm[doc]))
                best.add(accumulate(plan, scores), ids[at : at + len(texts)], missing[at : at + len(texts)])
        item, score, name, null = best.rows
        names = [plan.items[i][0] for i in item.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(names, pa.int64()), pa.array(name, mask=null), pa.array(score)], ["slot", "item_id", "doc_id", "score"])

    return run


def _plans(items: DataFrame) -> DataFrame:
    """``block, symbols, plan`` of the items, mined by tasks."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    blocks = max(1, -(-rows.count() // BLOCK_ITEMS))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ids, texts = group.column("item_id").to_pylist(), raw_bytes(group.column("text").combine_chunks())
        plan = mine(sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        return pa.table({"block": [key[0].as_py()], "symbols": pa.array([plan.symbols], pa.int64()), "plan": pa.array([pickle.dumps(plan)], pa.binary())})

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return written(keyed.groupBy("block").applyInArrow(run, "block long, symbols long, plan binary"), "lexical-plans")


def _passes(plans: DataFrame) -> Iterator[Plan]:
    """Plans of bounded size, each for one reading of the documents; a block is never cut."""
    group, size = [], 0
    for block, symbols in sorted((r.block, r.symbols) for r in plans.select("block", "symbols").collect()):
        if group and size + symbols > PASS_SYMBOLS:
            yield _loaded(plans, group)
            group, size = [], 0
        group.append(block)
        size += symbols
    if group:
        yield _loaded(plans, group)


def _loaded(plans: DataFrame, blocks: list[int]) -> Plan:
    return joined([pickle.loads(r.plan) for r in plans.where(F.col("block").isin(blocks)).orderBy("block").collect()])


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring documents of each item, scores above 0 only.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns are not read. Null and
    empty texts have no terms: such items get no rows, such documents count nowhere. Whole texts of any length are read,
    piece by piece. Repeated documents each count and each take a rank; equal scores go by ascending ``doc_id``,
    documents without an id last. An item is its id and text: repeated ones are answered once, and two texts under one id
    get a list each. Empty tables give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for plan in _passes(_plans(items)):
        if not plan.vocabulary:
            continue
        counted = narrow.select("text").mapInArrow(_statistics(plan.vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        df = {r.term: r.n for r in counted.collect()}  # a number for each term of the plan
        n_docs, n_terms = df.get(-1, 0), df.get(-2, 0)
        if not n_terms:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(plan.vocabulary))], np.int64)
        found = narrow.mapInArrow(_search(plan, weights, n_docs, n_terms, k), "slot long, item_id long, doc_id long, score long")
        found = found.withColumn("way", F.spark_partition_id() % MERGE_WAYS)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = found.withColumn("rank", F.row_number().over(Window.partitionBy("slot", "way").orderBy(*order))).where(F.col("rank") <= k)
        last = some.withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(*order))).where(F.col("rank") <= k)
        out = out.unionByName(last.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
lengths AS (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
asked AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(terms) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term), totals),
parts AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS part
  FROM tf JOIN lengths USING (row) JOIN weights USING (term), totals),
scored AS (SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY item_id, row),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
