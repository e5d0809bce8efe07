"""Exact top-k search by tiled matrix products (operator 9).

Candidates are packed into shards and queries into tiles, each a matrix of bounded size. A task holds a group of tiles
while a group of shards streams past: every tile meets every shard in one integer matrix product, of which the best
``k`` per query are kept. A shard is sent once for each group of tiles, not for each tile. The lists of a query are
merged over ever larger groups of shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.llm._common import bounded_batches, table
from wayfarer.llm.vectors import finite, matrix
from wayfarer.session import written

K = 5
EVERY = 50
SCALE = 256
SHARD_ROWS = 4096
TILE_ROWS = 1024
#: Tiles that a task holds and shards that stream past them, at most.
TILES, SHARDS = 32, 64
MERGE_FAN_IN = 16
#: Sums of integer products below these are exact in single and in double precision.
_EXACT_SINGLE, _EXACT = float(1 << 24), float(1 << 53)


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """One row per group: ids and scaled components, in the order of ids, in the narrowest numbers that hold them."""
    ids = rows.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    whole = np.floor(SCALE * matrix(rows.column("v").combine_chunks())[order])
    most = np.abs(whole).max(initial=0)
    whole = whole.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()), "m": pa.array([whole.tobytes()], pa.binary())})


_PACKED = "part long, dim int, ids binary, m binary"


def packed(vectors: DataFrame, rows_per_part: int) -> DataFrame:
    """``vectors`` (``vec_id, v``) as matrices of about ``rows_per_part`` rows of equal length."""
    counts = vectors.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.select("dim", F.ceil(F.col("n") / F.lit(rows_per_part)).cast("long").alias("parts"))
    keyed = vectors.withColumn("dim", F.size("v")).join(F.broadcast(parts), "dim")  # a row for each length of vector
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return keyed.select("part", "dim", "vec_id", "v").groupBy("part", "dim").applyInArrow(_pack, _PACKED)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in double precision where that is exact, else in unbounded integers."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if bound < _EXACT:
        kind = np.float32 if bound < _EXACT_SINGLE else np.float64
        return (q.astype(kind) @ c.T.astype(kind)).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(c).T
    bound = (1 << 63) - 1
    return np.array([[max(-bound, min(bound, x)) for x in row] for row in exact], np.int64)


def tile_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k best other candidates of each query; ties go to smaller ids."""
    scores = products(q, c)
    allowed = q_ids[:, None] != c_ids[None, :]
    low = np.iinfo(np.int64).min
    scores = np.where(allowed, scores, low)
    keep = min(k, len(c_ids))
    bar = np.partition(scores, len(c_ids) - keep, axis=1)[:, len(c_ids) - keep]
    rows, cols = np.nonzero((scores >= bar[:, None]) & allowed)  # all that tie with the k-th
    value = scores[rows, cols]
    order = np.lexsort((c_ids[cols], -value, rows))
    rows, cols, value = rows[order], cols[order], value[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best = place < k
    return q_ids[rows[best]], c_ids[cols[best]], value[best]


def group_sizes(tiles: int, shards: int, tasks: int) -> tuple[int, int]:
    """Tiles and shards of a cell: as large as allowed, but no larger than leaves a cell for each task, if there are enough.

    Shards are parted first, since a smaller group of tiles sends all shards once more.
    """
    tile_group, shard_group = min(TILES, tiles), min(SHARDS, shards)
    cells = lambda: -(-tiles // tile_group) * -(-shards // shard_group)
    while cells() < tasks and shard_group > 1:
        shard_group = -(-shard_group // 2)
    while cells() < tasks and tile_group > 1:
        tile_group = -(-tile_group // 2)
    return tile_group, shard_group


def _unpack(ids: bytes, m: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    width = len(m) // (len(names) * dim) if dim else 8
    return names, np.frombuffer(m, {2: np.int16, 4: np.int32, 8: np.float64}[width]).astype(np.float64).reshape(len(names), dim)


def _search(k: int):
    """Over tiles and shards sorted by cell, tiles first: the best of the cell's shards for each query of its tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        tiles: list[tuple[np.ndarray, np.ndarray]] = []
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = []

        def close() -> Iterator[pa.RecordBatch]:
            for found in best:
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), cell[1], np.int64)), *map(pa.array, found)], ["part", "query_id", "vec_id", "score"])

        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                here = (r["dim"], r["shards"], r["tiles"])
                if here != cell:
                    yield from close()
                    cell, tiles, best = here, [], []
                ids, m = _unpack(r["ids"], r["m"], r["dim"])
                if r["kind"] == 0:
                    tiles.append((ids, m))
                    best.append(None)
                    continue
                for i, (q_ids, q) in enumerate(tiles):
                    found = tile_top(q_ids, q, ids, m, k)
                    best[i] = found if best[i] is None else _merge(best[i], found, k)
        yield from close()

    return run


def _merge(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best of two lists of (query, candidate, score)."""
    q, c, s = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], c[keep], s[keep]


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of the highest integer inner product of each query.

    Both tables have ``vec_id`` and ``embedding``. Vectors that are null or hold null or non-finite components, and
    rows without an id, take no part. ``vec_id`` names a row: a query is answered once, and rows with its id are its
    own. Repeated candidate rows count each. Vectors of different lengths don't meet. Scores beyond 64 bits stop at
    the bound. Empty tables give no rows.
    """
    spark = candidates.sparkSession
    bounded_batches(spark)
    clean = lambda df: df.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = clean(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, tiles = written(packed(clean(candidates), SHARD_ROWS), "topk-shards"), written(packed(asked, TILE_ROWS), "topk-tiles")
    many = lambda df: (df.agg(F.max("part")).first()[0] or 0) + 1
    tile_group, shard_group = group_sizes(many(tiles), many(shards), n)
    shards = shards.withColumn("shards", F.floor(F.col("part") / F.lit(shard_group)))
    tiles = tiles.withColumn("tiles", F.floor(F.col("part") / F.lit(tile_group)))
    # Groups of tiles meet groups of shards of their length: blocks of the stated query set, not pairs of rows.
    groups = lambda df, name: df.groupBy("dim").agg(F.max(name).alias("last"))
    every = lambda df, other, name: df.join(F.broadcast(groups(other, name)), "dim").withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    columns = ["dim", "shards", "tiles", "kind", "part", "ids", "m"]
    both = every(tiles.withColumn("kind", F.lit(0)), shards, "shards").select(columns).unionByName(every(shards.withColumn("kind", F.lit(1)), tiles, "tiles").select(columns))
    met = both.repartition(n, "dim", "shards", "tiles").sortWithinPartitions("dim", "shards", "tiles", "kind", "part")
    found = met.mapInArrow(_search(k), "part long, query_id long, vec_id long, score long")
    last = shards.agg(F.max("shards")).first()[0] or 0
    best = [F.desc("score"), F.asc("vec_id")]
    while last > 0:
        last //= MERGE_FAN_IN
        found = found.withColumn("part", F.floor(F.col("part") / F.lit(MERGE_FAN_IN)))
        rank = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*best))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


OP9_SQL = f"""
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
