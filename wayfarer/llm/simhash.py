"""SimHash near-duplicates by covering locality-sensitive hashing (operator 1).

Fingerprint: words of the A-Z-lower-cased text, 4-word shingles with repeats, XXH64 (seed 42) of each, and a
bit-wise majority. Search: every bit position gets a vector of ``radius + 1`` bits; the mask of a table ``v`` keeps
the positions whose vector has an odd inner product with ``v``. The vectors of ``radius`` differing positions
cannot span the whole space, so some non-zero ``v`` is orthogonal to all of them and both fingerprints agree
under that mask: every pair within the radius collides in one of the ``2^(radius+1) - 1`` tables.

Work per document does not depend on the size of its group. Equal fingerprints collapse before the search. A
bucket is read as a sorted stream and gives a spanning forest of its links, never all pairs. A bucket of more than
``bucket_bound`` different fingerprints isn't compared in one task: its members are linked exactly through shared
variants (two fingerprints differ in at most 2k bits if and only if some string is within k of both), whose groups
are bounded by the number of such variants of one fingerprint.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm._common import bounded_batches, per_batch, raw_bytes, table
from wayfarer.operators.components import BoundedForest, connected_components
from wayfarer.session import written

BITS = 64
SEED = 42
SHINGLE = 4
RADIUS = 4
#: Different fingerprints of one bucket that a task compares directly (32 KB of them).
BUCKET_BOUND = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 bytes; 0 where there is no word."""
    words = text.lower().split()  # bytes: A-Z only, and splits at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):  # bounded memory for very long texts
        counts += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, shingle) for t in raw_bytes(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    return per_batch(run)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask per non-zero vector; positions get the non-zero vectors in turn, so masks are balanced."""
    space = 1 << (radius + 1)
    vector = [1 + i % (space - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, space)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bucket_edges(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct unsigned fingerprints, the nearest first."""
    if len(fps) == 2:
        a, b = fps.tolist()
        return [(a, b)] if (a ^ b).bit_count() <= radius else []
    edges, left = [], fps[1:].copy()
    away, parent = np.bitwise_count(left ^ fps[0]), np.full(len(left), fps[0])
    while len(left):
        i = int(away.argmin())
        x = left[i]
        if away[i] <= radius:
            edges.append((int(parent[i]), int(x)))
        left[i], away[i], parent[i] = left[-1], away[-1], parent[-1]  # the last takes its place
        left, away, parent = left[:-1], away[:-1], parent[:-1]
        d = np.bitwise_count(left ^ x)
        closer = d < away
        away[closer], parent[closer] = d[closer], x
    return edges


def _bucket_stream(masks: list[int], radius: int, bound: int):
    """Over rows (table, key, fp) sorted by table and key: edges, or (fp, fp) markers for hot buckets."""
    table_masks = np.array(masks, np.uint64)

    def out(kind: int, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        values = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), kind, np.int32)), pa.array(values[:, 0]), pa.array(values[:, 1])], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (table, key), the parts of a run that may go on in the next batch
        parts: list[np.ndarray] = []
        size, hot = 0, False

        def close() -> Iterator[pa.RecordBatch]:
            if not hot and size > 1:
                if edges := bucket_edges(np.unique(np.concatenate(parts)), radius):
                    yield out(0, edges)

        for batch in batches:
            t = batch.column(0).to_numpy()
            fp = batch.column(1).to_numpy().view(np.uint64)
            key = fp & table_masks[t]
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [len(t)]))
            last = len(starts) - 1
            first_key = (int(t[0]), int(key[0]))
            several = ends - starts > 1  # a bucket of one needs no look, unless it may go on in another batch
            several[[0, last]] = True
            for i in np.flatnonzero(several).tolist():
                a, b = int(starts[i]), int(ends[i])
                here = first_key if i == 0 else (int(t[a]), int(key[a]))
                if here != held:
                    yield from close()
                    held, parts, size, hot = here, [], 0, False
                size += b - a
                if size > bound:
                    hot = True
                    flagged = np.concatenate([*parts, fp[a:b]])
                    parts = []
                    yield out(1, np.stack([flagged, flagged], 1))
                else:
                    parts.append(fp[a:b])
        yield from close()

    return run


def _variants(radius: int, bits: int = BITS):
    """All strings within radius // 2 of each fingerprint, and one more bit on one side if radius is odd."""
    flips = [sum(1 << i for i in c) for k in range((radius + 1) // 2 + 1) for c in itertools.combinations(range(bits), k)]
    flip = np.array(flips, np.uint64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy().view(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ flip).ravel().view(np.int64)), pa.array(np.repeat(fp, len(flip)).view(np.int64))], ["variant", "fp"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield run(batch.slice(at, 64))

    return bounded


def _variant_forest(radius: int):
    """Over rows (variant, fp) sorted by variant: a spanning forest of the links that shared variants show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, members = BoundedForest(), None, []

        def close() -> list[tuple[int, int]]:
            fps = np.array(members, np.int64).view(np.uint64)
            pairs = bucket_edges(np.unique(fps), radius) if len(members) > 1 else []
            return [p for p in pairs if sets.joins(*p)]

        for batch in batches:
            variant, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(variant[1:] != variant[:-1]) + 1, [len(variant)]))
            edges: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if variant[a] != held:
                    edges += close()
                    held, members = variant[a], []
                members.extend(fp[a:b].tolist())
            if edges:
                e = np.array(edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])
        if edges := close():
            e = np.array(edges, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket_bound: int = BUCKET_BOUND) -> DataFrame:
    """Edges ``a, b`` that connect exactly the fingerprints connected by links of at most ``radius`` bits."""
    masks = covering_masks(radius)
    spark = fps.sparkSession
    distinct = fps.select("fp").where("fp IS NOT NULL").distinct()
    entries = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]))
    keyed = distinct.select("fp", entries.alias("e")).select(F.col("e.t").alias("t"), F.col("e.key").alias("key"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_runs = keyed.repartition(n, "t", "key").sortWithinPartitions("t", "key").select("t", "fp")
    found = written(sorted_runs.mapInArrow(_bucket_stream(masks, radius, bucket_bound), "kind int, a long, b long"), "simhash-links")
    cold = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return cold
    variants = hot.mapInArrow(_variants(radius), "variant long, fp long")
    runs = variants.repartition(n, "variant").sortWithinPartitions("variant")
    return cold.unionByName(runs.mapInArrow(_variant_forest(radius), "a long, b long"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket_bound: int = BUCKET_BOUND) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    A null text counts as empty: fingerprint zero, which links like any other. A null ``doc_id`` is never the
    smallest; a component of such rows alone has a null ``component_id``. Repeated rows stay as they are. Other
    columns of ``docs`` are not read, so clashing names do no harm; an empty table gives no rows.
    """
    marked = written(fingerprints(docs, shingle), "simhash-fp")
    roots = connected_components(fingerprint_links(marked, radius, bucket_bound))
    by_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    linked = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    group = F.coalesce("root", "fp")
    lows = linked.groupBy(group.alias("g")).agg(F.min("low").alias("component_id"))
    # Only fingerprints that several rows or several fingerprints share need a lookup; the rest stand alone.
    shared = linked.where("n > 1 OR root IS NOT NULL").select("fp", group.alias("g")).join(lows, "g").select("fp", "component_id", F.lit(True).alias("hit"))
    named = marked.join(shared, "fp", "left")
    return named.select("doc_id", "fp", F.when(F.col("hit"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash_components(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
