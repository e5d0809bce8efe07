"""Embedding near-duplicates by spherical-cap filters (operator 5).

Filter directions are a random product code: a vector is cut into two halves, each half has its own code of random
unit vectors, and every pair of code words is one direction. A vector is decoded to the list of all directions whose
inner product exceeds the cap's height; only code words of the first half that some word of the second could lift above
it are looked at. Vectors that share a direction (and a label) are compared in double precision, and a pair counts in
the smallest direction it shares, hence once.

Equal vectors collapse before the search. The number of directions follows the number of vectors of a label, and the height of the caps follows both, so that
a vector keeps about ``LISTS`` directions and a direction about ``BUCKET`` vectors at any size; the work for a vector
doesn't grow with the table. Only groups of vectors close to each other crowd a direction: its members are cut into
chunks, and a task compares two chunks: it returns the number of links of each member and a spanning forest of the
links, never the pairs.

Every vector has its ``LISTS`` best directions in any case, since a vector far from all code words would else have
few or none. ``tests/llm`` measures the recall against brute force, at the threshold and at several numbers of directions.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm._common import bounded_batches, table
from wayfarer.llm.vectors import finite, matrix
from wayfarer.operators.components import connected_components
from wayfarer.session import written

THRESHOLD = 0.93
#: Code words of a half for the smallest tables; doubled until directions are long enough apart.
CODE_WORDS = 64
#: Directions that a vector has about, and at least.
LISTS = 20
#: Vectors that a direction may have on average before the code grows.
BUCKET = 64
#: Best words of each half that a vector is decoded from: all of its directions, if they are no more than these.
BEST_WORDS = 64
CHUNK_ROWS = 512
SEED = 5


def code_words(rows: int) -> int:
    """Words of a half for a label of ``rows`` different vectors: directions are the square of it."""
    words = CODE_WORDS
    while rows * LISTS > BUCKET * words * words:
        words *= 2
    return words


def cap_height(words: int) -> float:
    """Height, in standard deviations of the inner product with a random direction, that leaves about 1.2 ``LISTS``."""
    return NormalDist().inv_cdf(1 - 1.2 * LISTS / words**2)


@functools.lru_cache(8)
def code(dim: int, words: int = CODE_WORDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Code words of both halves; halves of equal weight, so that every product has length one."""
    rng = np.random.default_rng([seed, dim] if words == CODE_WORDS else [seed, dim, words])
    halves = []
    for size in (dim - dim // 2, dim // 2):
        c = rng.standard_normal((words if size else 1, size))
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        share = np.sqrt(size / dim)
        halves.append(share * c / np.where(norm > 0, norm, 1))
    return halves[0], halves[1]


def _best(a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``n`` largest of each row."""
    n = min(n, a.shape[1])
    place = np.argpartition(a, a.shape[1] - n, axis=1)[:, a.shape[1] - n :]
    return place, np.take_along_axis(a, place, 1)


def decode(unit: np.ndarray, words: int = CODE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of all directions that rows exceed the height in; each row has its ``LISTS`` best at least."""
    dim = unit.shape[1]
    first, second = code(dim, words)
    i, a = _best(unit[:, : first.shape[1]] @ first.T, BEST_WORDS)
    j, b = _best(unit[:, first.shape[1] :] @ second.T, BEST_WORDS)
    sums = (a[:, :, None] + b[:, None, :]).reshape(len(unit), -1)
    own = min(LISTS, sums.shape[1])
    bar = np.partition(sums, sums.shape[1] - own, axis=1)[:, sums.shape[1] - own]
    rows, at = np.nonzero(sums >= np.minimum(bar, cap_height(words) / np.sqrt(dim))[:, None])
    return rows, i[rows, at // j.shape[1]].astype(np.int64) * second.shape[0] + j[rows, at % j.shape[1]]


def _narrow(m: np.ndarray) -> list[bytes]:
    """Rows as bytes, in single precision where that loses nothing."""
    single = m.astype(np.float32)
    same = (single == m).all(1)
    return [(s if k else d).tobytes() for s, d, k in zip(single, m, same, strict=True)]


def _widen(rows: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in rows], np.float64)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; rows are scaled by their largest component first, so that squares can't overflow."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


_ENTRY = "label long, dim int, direction long, id long, n long, v binary, directions binary"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _ENTRY.split(", ")]
    for batch in batches:
        label, ids, n = (batch.column(c).to_numpy() for c in ("label", "id", "n"))
        kinds = np.stack([batch.column(c).to_numpy() for c in ("dim", "words")], 1)
        for dim, words in np.unique(kinds, axis=0).tolist():
            where = np.flatnonzero((kinds == (dim, words)).all(1))
            for at in range(0, len(where), 256):
                some = where[at : at + 256]
                raw = matrix(batch.column("v").take(pa.array(some)))
                rows, direction = decode(unit_rows(raw), words)
                order = np.lexsort((direction, rows))
                rows, direction = rows[order], direction[order]
                own = [x.tobytes() for x in np.split(direction, np.flatnonzero(np.diff(rows)) + 1)]
                vectors = _narrow(raw)
                pick = some[rows]
                yield pa.RecordBatch.from_arrays([pa.array(label[pick]), pa.array(np.full(len(pick), dim, np.int32)), pa.array(direction), pa.array(ids[pick]), pa.array(n[pick]), pa.array([vectors[r] for r in rows], pa.binary()), pa.array([own[r] for r in rows], pa.binary())], names)


def _bitmap(lists: list[bytes], below: int) -> np.ndarray:
    """Bit sets, in 64-bit words, of the directions smaller than ``below`` that occur in the lists."""
    own = [np.frombuffer(x, np.int64) for x in lists]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    values = np.concatenate(own)
    row, values = row[values < below], values[values < below]
    known, column = np.unique(values, return_inverse=True)
    bits = np.zeros((len(lists), max(1, -(-len(known) // 64)) * 64), np.uint8)
    bits[row, column] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def chunk_links(direction: int, ids: np.ndarray, n: np.ndarray, unit: np.ndarray, lists: list[bytes], chunk: np.ndarray, across: bool, threshold: float):
    """Per member the links of pairs whose smallest common direction this is, and a spanning forest of all links."""
    left = np.flatnonzero(chunk == chunk.min())
    right = np.flatnonzero(chunk == chunk.max()) if across else left
    seen = _bitmap(lists, direction)
    counts = np.zeros(len(ids), np.int64)
    grown: list[np.ndarray] = []
    for at in range(0, len(left), 128):
        a = left[at : at + 128]
        i, j = np.nonzero(unit[a] @ unit[right].T >= threshold)
        i, j = a[i], right[j]
        keep = ids[i] != ids[j] if across else ids[i] < ids[j]
        i, j = i[keep], j[keep]
        if len(i):
            grown.append(np.stack([i, j], 1))
            fresh = np.concatenate([~(seen[i[x : x + 4096]] & seen[j[x : x + 4096]]).any(1) for x in range(0, len(i), 4096)])
            np.add.at(counts, i[fresh], n[j[fresh]])
            np.add.at(counts, j[fresh], n[i[fresh]])
    edges = _forest_of(np.concatenate(grown), len(ids)) if grown else np.zeros((0, 2), np.int64)
    return counts, edges


def _forest_of(pairs: np.ndarray, size: int) -> np.ndarray:
    """A star for each connected group of ``pairs``, by repeated minima."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(size))
    return np.stack([label[own], own], 1)


def _links(threshold: float):
    """Over rows sorted by label, length, direction and chunk pair: counts (kind 0) and edges (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        rows: list[dict] = []

        def close() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            label, dim, direction, p, q = held
            ids = np.array([r["id"] for r in rows], np.int64)
            n = np.array([r["n"] for r in rows], np.int64)
            unit = unit_rows(_widen([r["v"] for r in rows], dim))
            chunk = np.array([r["c"] for r in rows])
            if p != q and chunk.min() == chunk.max():
                return
            counts, edges = chunk_links(direction, ids, n, unit, [r["directions"] for r in rows], chunk, p != q, threshold)
            own = np.flatnonzero(counts)
            kind = np.concatenate([np.zeros(len(own), np.int32), np.ones(len(edges), np.int32)])
            a = np.concatenate([ids[own], ids[edges[:, 0]]])
            b = np.concatenate([counts[own], ids[edges[:, 1]]])
            if len(kind):
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                here = (r["label"], r["dim"], r["direction"], r["p"], r["q"])
                if here != held:
                    yield from close()
                    held, rows = here, []
                rows.append(r)
        yield from close()

    return run


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding, label``).

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing. Equal vectors of a label link with each other, repeated rows too. A null ``vec_id`` is never the smallest
    of its component; ``kept`` compares null-safely. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    some = F.exists("v", lambda x: x != 0)
    valid = rows.where(finite(F.col("v")) & F.col("label").isNotNull() & F.coalesce(some, F.lit(False)))
    classes = valid.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "label", "v", F.size("v").alias("dim"), "low", "n"), "embedding-classes")
    bounded_batches(spark)
    # One row for each label and length of vector; the code of each is as large as it has vectors.
    counts = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows"))
    doublings = F.ceil(F.log2(F.sqrt(F.col("rows") * LISTS / BUCKET) / CODE_WORDS))
    counts = counts.select("label", "dim", (F.lit(CODE_WORDS) * F.pow(F.lit(2), F.greatest(doublings, F.lit(0)))).cast("int").alias("words"))
    entries = classes.join(counts, ["label", "dim"]).select("label", "id", "n", "dim", "words", "v").mapInArrow(_decode, _ENTRY)
    keys = ["label", "dim", "direction"]
    sizes = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    crowded = sizes.where(F.col("m") > chunk_rows).select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("m") / F.lit(chunk_rows)).cast("int").alias("k"))
    crowded = written(crowded, "embedding-crowded")
    on = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("direction") == F.col("_direction"))
    placed = entries.join(crowded, on, "left").withColumn("k", F.coalesce("k", F.lit(1)))
    placed = placed.withColumn("c", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    # A member meets the members of every chunk of its direction in one task each.
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    met = placed.withColumn("o", other).withColumn("p", F.least("c", "o")).withColumn("q", F.greatest("c", "o"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, "p", "q"]
    met = met.select(*order, "c", "id", "n", "v", "directions").repartition(n, *order).sortWithinPartitions(*order)
    found = written(met.mapInArrow(_links(threshold), "kind int, a long, b long"), "embedding-links")
    degree = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("others"))
    roots = connected_components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "id")
    whole = classes.join(degree, "id", "left").join(roots, "id", "left").withColumn("group", F.coalesce("root", "id"))
    lows = whole.groupBy("group").agg(F.min("low").alias("component_id"))
    told = whole.join(lows, "group").select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    told = told.where("links > 0")
    named = rows.join(told, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    component = F.when(F.col("links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    out = named.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE clean AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
       CAST(least(vec_id, coalesce(low, vec_id)) AS BIGINT) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN parts ON parts.a = vec_id LEFT JOIN degrees ON degrees.a = vec_id
"""
