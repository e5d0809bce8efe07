"""Removal of near copies by SimHash (the pipeline's form of operator 1).

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 at least. A SimHash of
shingles is a poor guide to that: one changed word changes five shingles, and at a similarity of 0.8 some ten of 64 bits
differ. Candidates therefore come from a SimHash of the words, each weighed by the logarithm of one plus its count, in
which near copies lie within few bits; there are four, and one that is near is enough. The covering tables of :mod:`wayfarer.llm.simhash` find all pairs within the
radius and link each fingerprint to its nearest; the exact similarity then decides on every link.

Fingerprints alone would leave pairs out, short texts above all. What they have not joined is joined by prefixes: of two
texts that are alike, the rarest shingles share one (:func:`missing_links`). Large groups of near copies are one set by then
and meet nobody of their own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm._common import bounded_batches, per_batch, raw_bytes
from wayfarer.llm.simhash import BITS, RADIUS, SEED, fingerprint_links
from wayfarer.operators.components import connected_components
from wayfarer.session import written

SHINGLE = 5
SIMILARITY = 0.8
#: Independent fingerprints of a text, each of 64 bits. A pair needs to lie within the radius in one of them only.
FINGERPRINTS = 4
#: Fingerprints of a bucket that one task links (0.5 MB); larger buckets go the way of shared variants.
BUCKET_BOUND = 1 << 15
#: Shingles that so many texts have are common and come last in the order of shingles; of more than ``MOST_COMMON`` such
#: the rarer ones count as the others (16 bytes each are broadcast).
COMMON, MOST_COMMON = 8, 1 << 19
#: Bytes of text whose shingles are counted in one group of hashes.
COUNTED_BYTES = 4 << 20
#: Texts that share a shingle of their prefixes and that one task pairs; larger groups are cut into slices.
GROUP_BOUND = 2_000
#: 64-bit words of a text's parities, and texts that show a shingle from which on parities travel with it: fewer make few pairs.
PARITIES, MANY = 8, 100
#: Texts that travel with the pairs compared at one time, as a multiple of the different texts among them.
PART_SHARE = 2


def word_fingerprints(text: bytes, n: int = FINGERPRINTS) -> list[int]:
    """``n`` SimHashes of the words of a text, weighed by the logarithm of one plus the count; 0 without words."""
    counts = Counter(text.lower().split())
    if not counts:
        return [0] * n
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in counts), np.uint64, len(counts))
    weight = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    ones = np.zeros((n, BITS))
    for at in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        some = h[at : at + (1 << 14)]
        for k in range(n):
            own = some if k == 0 else _remix(some, k)
            ones[k] += weight[at : at + (1 << 14)] @ np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits((2 * ones > weight.sum()).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes as good as independent of ``h``: two rounds of multiplying and folding, different for every ``k``."""
    for odd in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93):
        h = (h + np.uint64(k)) * np.uint64(odd)
        h = h ^ (h >> np.uint64(32))
    return h


def shingle_set(text: str | None, shingle: int = SHINGLE) -> frozenset[bytes]:
    """Different shingles of the A-Z-lower-cased words; all words together where there are fewer; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))


def jaccard(a: frozenset, b: frozenset) -> float:
    """Share of common members; two empty sets are equal."""
    return len(a & b) / len(a | b) if a or b else 1.0


def _marks(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Fingerprints of the words, and 128 bits of the words themselves, of each text."""
    bodies = raw_bytes(batch.column(1))
    fps = np.array([word_fingerprints(t) for t in bodies], np.uint64).view(np.int64).tolist()
    marks = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in bodies]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64())), pa.array(marks, pa.binary()), *batch.columns[2:]], ["doc_id", "fps", "mark", *batch.schema.names[2:]])


def _alike(shingle: int, similarity: float):
    """Keep the pairs of texts whose shingle sets are similar enough; the set of a text seen just before is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str | None, frozenset] = (None, frozenset())
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if x is None or x != held[0]:
                    held = (x, shingle_set(x, shingle))
                keep.append(jaccard(held[1], shingle_set(y, shingle)) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified_links(classes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` between ``classes`` (``id, fps`` and the ``d, h1, h2`` that find a text in ``texts``).

    The forests of the covering tables link fingerprints, nearest first; classes of one fingerprint form a star.
    Pairs that are near in none of the fingerprints are left to :func:`missing_links`.
    """
    found: DataFrame | None = None
    for k in range(FINGERPRINTS):
        own = classes.select("id", F.col("fps")[k].alias("fp"))
        near = fingerprint_links(own, radius, BUCKET_BOUND).distinct()
        first = own.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        end = lambda n: first.select(F.col("fp").alias(n), F.col("first").alias(f"id_{n}"))  # noqa: E731, B023
        across = near.join(end("a"), "a").join(end("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        within = own.join(first.where("n > 1"), "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
        both = across.unionByName(within)
        found = both if found is None else found.unionByName(both)
    pairs = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    return _verified(pairs, classes, texts, shingle, similarity)


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` that are alike. Texts are only fetched for classes that have a candidate.

    Both texts travel with a pair. Where the pairs' texts are more than the fetched texts themselves, pairs are compared in
    parts of about that size, one after the other, so the disk in use doesn't grow with the number of pairs.
    """
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = classes.join(asked, "id").select("id", F.col("d").alias("_d"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    same = F.col("d").eqNullSafe(F.col("_d")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    fetched = written(wanted.join(texts, same).dropDuplicates(["id"]).select("id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")), "near-texts")
    sizes = lambda n: fetched.select(F.col("id").alias(n), F.col("size").alias(f"size_{n}"))
    travel = pairs.join(sizes("a"), "a").join(sizes("b"), "b").agg(F.sum(F.col("size_a") + F.col("size_b"))).first()[0] or 0
    parts = max(1, math.ceil(travel / max(1, PART_SHARE * (fetched.agg(F.sum("size")).first()[0] or 0))))
    side = lambda n: fetched.select(F.col("id").alias(n), F.col("text").alias(f"text_{n}"))
    found: DataFrame | None = None
    for part in range(parts):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == part) if parts > 1 else pairs
        both = some.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
        links = written(both.mapInArrow(_alike(shingle, similarity), "a long, b long"), "near-links")
        found = links if found is None else found.unionByName(links)
    return found


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the different shingles of :func:`shingle_set`, ascending."""
    words = text.lower().split()
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(shingle, len(h))
    mixed = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        mixed = _remix(mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j], j + 1)
    return np.unique(mixed)


def _counted(shingle: int, bits: int):
    """Shingles of a batch of texts and how many of its texts have them, by the first ``bits`` of their hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingle_hashes(text, shingle) for text in raw_bytes(batch.column(0)))]), return_counts=True)
        ends = np.searchsorted(h, (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64))
        some = [(i, x.tobytes(), y.astype(np.int32).tobytes()) for i, (x, y) in enumerate(zip(np.split(h, ends), np.split(n, ends), strict=True)) if len(x)]
        group, hashes, counts = zip(*some, strict=True) if some else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["group", "hashes", "counts"])

    return run


def _common(least: int):
    """Those hashes of a group that ``least`` texts have."""

    def run(group: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        h, at = np.unique(join("hashes", np.uint64), return_inverse=True)
        n = np.bincount(at, join("counts", np.int32), len(h)).astype(np.int64)
        return pa.table({"hash": h[n >= least].view(np.int64), "n": n[n >= least]})

    return run


def shingle_ranks(texts: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the common shingles, ascending, and how many texts have each; ``MOST_COMMON`` of them or few more."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = math.ceil(math.log2(max(1, size / COUNTED_BYTES)))
    counted = texts.select("text").mapInArrow(per_batch(_counted(shingle, bits)), "group int, hashes binary, counts binary")
    common = written(counted.groupBy("group").applyInArrow(_common(COMMON), "hash long, n long"), "near-common")
    total = common.count()
    if total > MOST_COMMON:
        bound = common.agg(F.percentile_approx("n", 1 - MOST_COMMON / total, 100_000)).first()[0]
        common = common.where(F.col("n") > bound)
    found = common.toArrow()
    h, n = found.column("hash").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _ranked(h: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many texts have each of ``h``; 0 for all that aren't common."""
    common, n = ranks
    if not len(common):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return np.where(common[at] == h, n[at], 0)


def _parities(h: np.ndarray) -> np.ndarray:
    """Of each of 64 times ``PARITIES`` classes of hashes whether an odd number of them is in ``h``.

    Two sets have at least as many members that only one of them has as parities that differ.
    """
    odd = np.bincount((h % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _least(share: float, n: int) -> int:
    """Smallest whole number that is ``share`` of ``n`` at least; rounding never makes it larger."""
    return max(1, int(np.ceil(share * n - 1e-6)))


def _prefixes(shingle: int, similarity: float, ranks):
    """Of each text the shingles of its prefix; by the first ``own`` of them it is met as the smaller one of a pair.

    Two sets of which ``o`` members are common share one of their first ``n - o + 1`` members in any order. With sets of at
    most its own size a set shares ``similarity`` of itself, with larger ones more. ``last`` is where the prefix ends in the
    order and ``rest`` how many shingles come after it; ``p0`` and on are its :func:`_parities`.
    """
    inner = 2 * similarity / (1 + similarity)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shown, sizes, own, last, parities = [], [], [], [], []
        for text in raw_bytes(batch.column(1)):
            h = shingle_hashes(text, shingle)
            n = len(h)
            keep = n - _least(similarity, n) + 1 if n else 0
            rank, signed = _ranked(h, ranks.value), h.view(np.int64)
            first = np.lexsort((signed, rank))[:keep]
            shown.append(signed[first])
            parities.append(_parities(h))
            sizes.append(n)
            own.append(n - _least(inner, n) + 1 if n else 0)
            last.append({"rank": int(rank[first[-1]]), "hash": int(signed[first[-1]])} if n else None)
        offsets = np.concatenate([[0], np.cumsum([len(h) for h in shown])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *shown])))
        rest = np.array(sizes, np.int64) - np.diff(offsets)
        ends = pa.array(last, pa.struct([("rank", pa.int64()), ("hash", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes, pa.int32()), pa.array(own, pa.int32()), ends, pa.array(rest, pa.int32()), *batch.columns[2:], *map(pa.array, np.array(parities).T.copy())], ["d", "shown", "size", "own", "last", "rest", *batch.schema.names[2:], *(f"p{i}" for i in range(PARITIES))])

    return run


def _near_parities(similarity: float):
    """A bound on the shingles that only one of two texts ``a`` and ``b`` has: at least as many as parities differ."""
    differ = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITIES)), F.lit(0))
    return differ <= (1 - similarity) / (1 + similarity) * (F.col("size_a") + F.col("size_b")) + 1e-6


def _enough(pairs: DataFrame, ends: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``a, b``, and ``n``: the shingles that both show) that can be alike, by ``ends`` (``id, size, last, rest`` and parities).

    Of two prefixes one ends first. What the sets have in common up to there both show, and after it there is no more in
    common than that set's rest; so ``n`` and the rest together bound the common shingles.
    """
    side = lambda n: ends.select(F.col("id").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("size", "last", "rest", *(f"p{i}" for i in range(PARITIES)))))
    most = F.col("n") + F.when(F.col("last_a") < F.col("last_b"), F.col("rest_a")).when(F.col("last_b") < F.col("last_a"), F.col("rest_b")).otherwise(F.least("rest_a", "rest_b"))
    least = similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
    return pairs.join(side("a"), "a").join(side("b"), "b").where((most >= least) & _near_parities(similarity)).select("a", "b")


def missing_links(classes: DataFrame, texts: DataFrame, roots: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``a, b`` between classes that are alike and that ``roots`` (``id, root``) has in different sets; none is missing.

    Shingles are in order of how common they are, and each text shows its first ones (see :func:`_prefixes`); the
    order decides on the cost alone. Texts that share a shown shingle, lie in different sets, don't differ too much in
    size and in parities (see :func:`_near_parities`) and show enough shingles in common (see :func:`_enough`) are compared.
    """
    ranks = texts.sparkSession.sparkContext.broadcast(shingle_ranks(texts, shingle))
    wanted = classes.select("id", F.col("d").alias("_d"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    same = F.col("d").eqNullSafe(F.col("_d")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    parities = [f"p{i}" for i in range(PARITIES)]
    columns = "d long, shown array<long>, size int, own int, last struct<rank long, hash long>, rest int, h1 long, h2 long, " + ", ".join(f"{p} long" for p in parities)
    shown = texts.select("d", "text", "h1", "h2").mapInArrow(per_batch(_prefixes(shingle, similarity, ranks)), columns)
    # Rows that agree in id and text show the same twice; that only makes more of their pairs look alike before they are compared.
    shown = written(shown.join(wanted, same).where("size > 0").select("id", "root", "size", "own", "last", "rest", "shown", *parities), "near-prefixes")
    # Shingles shown within one set only have nothing to join.
    met = shown.select("root", F.explode("shown").alias("hash")).groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    met = written(met.where("low <> high").select("hash", "n", F.ceil(F.col("n") / GROUP_BOUND).cast("int").alias("slices")), "near-met")
    rows = shown.select("id", "root", "size", "own", F.posexplode("shown").alias("nth", "hash"), *parities).join(met, "hash")
    rows = written(rows.select("hash", "slices", "id", "root", "size", "nth", (F.col("nth") < F.col("own")).alias("own"), *(F.when(F.col("n") >= MANY, F.col(p)).alias(p) for p in parities)), "near-shown")
    left = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    right = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    side = lambda df, n: df.select("hash", "slice", F.col("id").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("size", "root", "own", "nth", *parities)))
    pairs = side(left, "a").join(side(right, "b"), ["hash", "slice"]).where(F.col("root_a") != F.col("root_b"))
    smaller = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    pairs = pairs.where(smaller & (F.col("size_a") >= F.col("size_b") * similarity - 1e-6) & (F.col("p0_a").isNull() | _near_parities(similarity)))
    # Before the first shingle that two sets share there are ``nth`` in each that the other lacks.
    first = F.least(F.col("size_a") - F.col("nth_a"), F.col("size_b") - F.col("nth_b")) >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("own_a") & first).alias("own")).where("own")
    ends = shown.select("id", "size", "last", "rest", *parities).dropDuplicates(["id"])
    pairs = _enough(written(pairs.select("a", "b", "n"), "near-prefix-pairs"), ends, similarity)
    return _verified(written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "near-enough"), classes, texts, shingle, similarity)


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` without all but one row of each group of near copies: the row of the smallest ``doc_id``.

    Groups are the connected components of verified links. Texts that are equal but for A-Z case and white space are
    always grouped, so null, empty and blank texts form one group. Null ids come last; within one id the text of the
    smallest hash stays. A keeper is found again by id and 128 bits of its text's hash, so groups that share an id, or
    have none, each keep a row of their own; of repeated rows one stays. Very long texts count as a whole. Further
    columns are carried in a struct, so no name can clash. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    h1, h2 = F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(SEED), "text").alias("h2")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h1, h2)
    marked = written(narrow.mapInArrow(per_batch(_marks), "doc_id long, fps array<long>, mark binary, h1 long, h2 long"), "near-marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")).alias("low")
    classes = marked.groupBy("mark").agg(first, F.min("fps").alias("fps"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "fps", "low", F.col("low.doc_id").alias("d"), "low.h1", "low.h2"), "near-classes")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), h1, h2, "text")
    near = verified_links(classes, texts, shingle, similarity, radius)
    roots = connected_components(near).withColumnRenamed("node", "id")
    roots = connected_components(near.unionByName(missing_links(classes, texts, roots, shingle, similarity))).withColumnRenamed("node", "id")
    lows = classes.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("g")).agg(F.min("low").alias("low")).select("low.doc_id", "low.h1", "low.h2")
    # Rows that agree in id and text are in one group; only keepers that have such copies need a second look.
    copies = marked.groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toDF("c_id", "c1", "c2", "n")
    keepers = lows.join(copies, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    keepers = keepers.select(F.col("doc_id").alias("keep"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.coalesce("n", F.lit(1)).alias("n"))
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), h1, h2, F.struct("*").alias("doc"))
    kept = whole.join(keepers, F.col("id").eqNullSafe(F.col("keep")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    once = kept.where("n = 1").select("doc.*")
    again = kept.where("n > 1").dropDuplicates(["id", "h1", "h2"]).select("doc.*")
    return once.unionByName(again)
