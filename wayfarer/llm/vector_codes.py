"""Compression of vectors to product codes, nearest entries found in a geometric near-neighbour access tree (operator 11).

Components become integers and vectors are cut into parts. Each part position has a codebook, refined in rounds: a round
assigns every part to its nearest entry and moves each entry to the floor of its parts' mean. Vectors stay where they are
and only sums by entry are shuffled; the driver sees the codebooks, whose size doesn't depend on the number of vectors.

The tree (GNAT) over a codebook picks split points, gives every other entry to its nearest split point, and stores for
each pair of a split point and a group the range of distances from the one to the other. A query's distance to a split
point rules out each group whose range lies farther from it than the best entry so far. Ranges and distances are
rounded outward and a group goes only if it is strictly farther, so ties survive; what remains is compared by exact
integers, and the lower index wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm._common import bounded_batches, table
from wayfarer.llm.vectors import finite
from wayfarer.session import written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Components stop here.
BOUND = 1 << 62
#: Split points of an inner node, and entries of a leaf.
FAN, LEAF = 8, 12
#: Relative error of a distance in doubles, with room to spare.
EPS = 1e-12
_HALF = 31
_ROWS = 4096


def squared(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, in the narrowest numbers that hold them: doubles, longs, Python integers."""
    most = 2 * max(_most(q), _most(e))
    bound = 4 * most * most * max(1, q.shape[1])
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    q, e = q.astype(kind), e.astype(kind)
    return (q * q).sum(axis=1)[:, None] - 2 * (q @ e.T) + (e * e).sum(axis=1)[None, :]


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


@dataclass
class Node:
    """A leaf has only entries; an inner node its split points, the ranges to each group, and the groups' nodes."""

    entries: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    groups: list["Node | None"] | None = None


class Gnat:
    """Nearest entries of a codebook; of equally near ones the lowest index."""

    def __init__(self, entries: np.ndarray, fan: int = FAN, leaf: int = LEAF) -> None:
        self.entries, self.fan, self.leaf = entries, fan, leaf
        self.compared = 0
        _, first = np.unique(entries, axis=0, return_index=True) if entries.shape[1] else (None, np.array([0]))
        self.top = self._node(np.sort(first))  # a later copy of an entry never wins

    def _node(self, own: np.ndarray) -> Node:
        if len(own) <= max(self.leaf, self.fan):
            return Node(own)
        splits, nearest = [0], None
        apart = []
        for _ in range(self.fan):  # each split point is the farthest from those before it
            d = squared(self.entries[own], self.entries[own[splits[-1:]]])[:, 0]
            apart.append(d)
            nearest = d if nearest is None else np.minimum(nearest, d)
            splits.append(int(np.argmax(nearest)))
        splits = splits[: self.fan]
        distances = np.stack(apart)  # split points by entries
        home = np.argmin(distances, axis=0)
        home[splits] = -1
        roots = _roots(distances)
        low, high, groups = np.empty((self.fan, self.fan)), np.empty((self.fan, self.fan)), []
        for j, split in enumerate(splits):
            group = np.flatnonzero(home == j)
            whole = np.append(group, split)
            low[:, j] = roots[:, whole].min(axis=1) * (1 - EPS)
            high[:, j] = roots[:, whole].max(axis=1) * (1 + EPS)
            groups.append(self._node(own[group]) if len(group) else None)
        return Node(own[splits], low, high, groups)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, exact squared distance) of each row; distances are Python integers where longs are too short."""
        wide = 4 * (2 * max(_most(q), _most(self.entries))) ** 2 * max(1, q.shape[1]) >= 1 << 62
        best = np.full(len(q), -1, np.int64)
        far = np.full(len(q), None if wide else 0, object if wide else np.int64)
        if len(q):
            self._visit(self.top, q, np.arange(len(q)), best, far)
        return best, far

    def _offer(self, q: np.ndarray, rows: np.ndarray, entries: np.ndarray, best: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Compare rows with entries exactly; the distances to the first entry are returned."""
        self.compared += len(rows) * len(entries)
        d = squared(q[rows], self.entries[entries])
        at = np.argmin(d, axis=1)  # the first of equals, and entries of a leaf are in order of index
        found, index = d[np.arange(len(rows)), at].astype(far.dtype), entries[at]
        old = best[rows]
        fresh = old < 0
        better = fresh.copy()
        known = ~fresh
        better[known] = (found[known] < far[rows[known]]) | ((found[known] == far[rows[known]]) & (index[known] < old[known]))
        best[rows[better]], far[rows[better]] = index[better], found[better]
        return d[:, 0]

    def _visit(self, node: Node, q: np.ndarray, rows: np.ndarray, best: np.ndarray, far: np.ndarray) -> None:
        if node.groups is None:
            self._offer(q, rows, node.entries, best, far)
            return
        n = len(node.entries)
        alive = np.ones((len(rows), n), bool)
        seen = np.full((len(rows), n), np.nan)  # distances to split points
        for i in range(n):
            here = np.flatnonzero(alive[:, i])
            if not len(here):
                continue
            seen[here, i] = _roots(self._offer(q, rows[here], node.entries[i : i + 1], best, far))
            reach = _roots(far[rows[here]]) * (1 + EPS)
            alive[here] &= ~self._beyond(seen[here, i][:, None], node.low[i], node.high[i], reach[:, None])
        for j, group in enumerate(node.groups):
            here = np.flatnonzero(alive[:, j])
            if group is None or not len(here):
                continue
            reach = _roots(far[rows[here]]) * (1 + EPS)  # smaller than when the split points were met
            gone = self._beyond(seen[here], node.low[:, j], node.high[:, j], reach[:, None]).any(axis=1)
            if not gone.all():
                self._visit(group, q, rows[here[~gone]], best, far)

    @staticmethod
    def _beyond(d: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether all members of a range are strictly farther than ``reach``; an unknown distance rules nothing out."""
        return (d * (1 - EPS) - high > reach) | (low - d * (1 + EPS) > reach)


def _whole(column: pa.Array) -> np.ndarray:
    """Rows of integer lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _parts(x: np.ndarray) -> list[np.ndarray]:
    width = x.shape[1] // PARTS
    return [x[:, p * width : (p + 1) * width] for p in range(PARTS)]


def _sums(books: list[np.ndarray]):
    """Sums of the parts of each entry, as two halves that don't overflow, and their number as one more component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, width = [Gnat(b) for b in books], books[0].shape[1]
        upper, lower = (np.zeros((PARTS, len(books[0]), width + 1), np.int64) for _ in range(2))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                for p, x in enumerate(_parts(_whole(batch.column("v").slice(at, _ROWS)))):
                    entry, _ = trees[p].nearest(x)
                    np.add.at(upper[p, :, :width], entry, x >> _HALF)
                    np.add.at(lower[p, :, :width], entry, x & ((1 << _HALF) - 1))
                    lower[p, :, width] += np.bincount(entry, minlength=len(books[p]))
        part, entry = np.nonzero(lower[:, :, width])
        if len(part):
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width + 1, dtype=np.int32)), pa.array(x.ravel())) for x in (upper[part, entry], lower[part, entry])]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), *lists], ["part", "entry", "upper", "lower"])

    return run


def refine(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry moves to the floor of the mean of the parts assigned to it; unused ones stay."""
    sums = vectors.select("v").mapInArrow(_sums(books), "part int, entry int, upper array<long>, lower array<long>")
    by_place = sums.select("part", "entry", F.posexplode(F.arrays_zip("upper", "lower")).alias("at", "x"))
    total = by_place.groupBy("part", "entry", "at").agg(F.sum(F.col("x.upper").cast("decimal(38,0)")).alias("upper"), F.sum(F.col("x.lower").cast("decimal(38,0)")).alias("lower"))
    width = books[0].shape[1]
    found: dict[tuple[int, int], list[int]] = {}
    for r in total.collect():  # a number for each component of the codebooks
        found.setdefault((r.part, r.entry), [0] * (width + 1))[r["at"]] = (int(r.upper) << _HALF) + int(r.lower)
    out = [b.copy() for b in books]
    for (p, e), x in found.items():
        out[p][e] = [s // x[width] for s in x[:width]]
    return out


_CODED = "vec_id long, label string, code string, error long"


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                found = [tree.nearest(x) for tree, x in zip(trees, _parts(_whole(some.column("v"))), strict=True)]
                code = [bytes(x).hex() for x in np.stack([e for e, _ in found], axis=1).astype(np.uint8)]
                error = sum(d.astype(object) for _, d in found)
                error = np.array([min(int(x), (1 << 63) - 1) for x in error], np.int64)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(code), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v``: floors of the scaled components, all of one length that the parts divide."""
    clean = vectors.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    bound = F.lit(float(BOUND))
    whole = F.transform("x", lambda x: F.floor(F.greatest(F.least(F.lit(float(SCALE)) * x, bound), -bound)).cast("long"))
    most = clean.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-most // PARTS) * PARTS
    return clean.select("vec_id", "label", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("v"))


def train(whole: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of ``whole`` (``vec_id, v``), first the parts of the smallest ids; empty without vectors."""
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    if not first:
        return []
    books = _parts(np.array([r.v for r in first], np.int64).reshape(len(first), -1))
    for _ in range(rounds):
        books = refine(whole, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of ``vectors`` (``vec_id, embedding, label``).

    Vectors that are null or hold null or non-finite components take no part. Shorter vectors than the longest are filled
    up with zeros, as is a length that four doesn't divide; that changes no distance. Fewer than 256 vectors make fewer
    entries. Of equally near entries the lower index wins, also among equal entries. Repeated rows and ids each get a
    row; rows without an id come last where the first codebook is taken, and equal ids in the order of their vectors.
    Null labels are one label. Components beyond 2^62 and errors beyond 2^63 - 1 stop there. Other columns are not read,
    and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = written(integer_vectors(vectors), "codes-vectors")
    books = train(whole, rounds)
    if not books:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(whole.mapInArrow(_codes(books), _CODED), "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    both = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _round_sql(r: int) -> str:
    """Nearest entries of book ``r`` and the book after it. A key holds distance and index, so its minimum breaks ties."""
    return f"""
near{r} AS (
  SELECT s.rid, s.p, min(CAST(s.norm - 2 * list_dot_product(s.w, b.w) + list_dot_product(b.w, b.w) AS BIGINT) * {ENTRIES} + b.e) AS key
  FROM slices s JOIN book{r} b USING (p) GROUP BY s.rid, s.p),
means{r} AS (
  SELECT p, e, list(m ORDER BY pos) AS w FROM (
    SELECT p, e, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS DOUBLE) AS m FROM (
      SELECT s.p, n.key % {ENTRIES} AS e, unnest(s.w) AS x, generate_subscripts(s.w, 1) AS pos FROM slices s JOIN near{r} n USING (rid, p))
    GROUP BY p, e, pos) GROUP BY p, e),
book{r + 1} AS (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM book{r} b LEFT JOIN means{r} m USING (p, e)),"""


OP11_SQL = f"""
WITH clean AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
slices AS MATERIALIZED (
  SELECT rid, p, w, list_dot_product(w, w) AS norm FROM (
    SELECT rid, p, list_slice(v, CAST(p * len(v) // {PARTS} + 1 AS BIGINT), CAST((p + 1) * len(v) // {PARTS} AS BIGINT)) AS w FROM clean, range({PARTS}) AS r(p))),
book0 AS (SELECT p, rid AS e, w FROM slices WHERE rid < {ENTRIES}),
{"".join(_round_sql(r) for r in range(ROUNDS))}
last AS (
  SELECT s.rid, s.p, min(CAST(s.norm - 2 * list_dot_product(s.w, b.w) + list_dot_product(b.w, b.w) AS BIGINT) * {ENTRIES} + b.e) AS key
  FROM slices s JOIN book{ROUNDS} b USING (p) GROUP BY s.rid, s.p),
codes AS (SELECT rid, string_agg(printf('%02x', key % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(key // {ENTRIES}) AS BIGINT) AS error FROM last GROUP BY rid),
hashed AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, pos)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM book{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN clean USING (rid), hashed
"""
