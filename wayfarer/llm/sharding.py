"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (operator 3).

Rows fall into cells by a hash, so a cell is the same whoever computes it. For each cell the numbers of rows it
sends to every shard are drawn without replacement from what the shards still take (a multivariate hypergeometric
draw); the matrix of these counts is all that the driver sees. Each cell permutes its rows and deals them out by the
matrix; each shard permutes what it got. Law ``rows``: shard sizes differ by one at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wayfarer.llm._common import repeated, table, utf8
from wayfarer.session import written

SHARDS = 24
SEED = 20_240
#: Rows that a cell should have; the number of cells, and so the matrix, is bounded by ``MAX_CELLS``.
CELL_ROWS = 50_000
MAX_CELLS = 4096


def communication_matrix(cell_rows: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows per (cell, shard): row sums are ``cell_rows``, column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(cell_rows)
    left = np.full(shards, total // shards, np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    matrix = np.zeros((len(cell_rows), shards), np.int64)
    for i, n in enumerate(cell_rows):
        matrix[i] = _draw(rng, left, n)
        left -= matrix[i]
    return matrix


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw, one shard after the other."""
    out, rest, pool = np.zeros_like(left), n, int(left.sum())
    for j, k in enumerate(left.tolist()):
        if rest == 0:
            break
        out[j] = hypergeometric(rng, k, pool - k, rest)
        rest -= int(out[j])
        pool -= k
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, population: int = 1_000_000_000) -> int:
    """How many of ``n`` draws without replacement are good, for any population (numpy's own draw ends at 10^9).

    Give every item a uniform number and take the ``n`` smallest. How many numbers of either kind lie below a bound is
    binomial, so the bound splits the items in two: one part is taken, or left, as a whole, and the other one is split on.
    """
    taken = 0
    while good + bad >= population and 0 < n < good + bad:
        bound = n / (good + bad)
        g, b = int(rng.binomial(good, bound)), int(rng.binomial(bad, bound))
        if g + b >= n:
            good, bad = g, b
        else:
            taken, n, good, bad = taken + g, n - g - b, good - g, bad - b
    if n == 0 or good == 0:
        return taken
    if bad == 0 or n == good + bad:
        return taken + min(good, n)
    return taken + int(rng.hypergeometric(good, bad, n))


_ROW = ["doc_id", "text_crc32", "size", "copy"]


def _order(seed: int, round_no: int) -> list[Column]:
    """A pseudo-random order of rows that any retry repeats; equal rows are told apart by their number."""
    return [F.xxhash64(F.lit(seed + round_no), *_ROW), *map(F.col, _ROW)]


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    Null texts have size 8 and the CRC of no bytes; null ids are rows like any other, repeated rows are kept, an
    empty table gives no rows. Texts themselves are never shuffled, only 24 bytes a row. Equal rows are counted first and
    numbered apart, so that any number of them is spread over all cells.
    """
    spark = docs.sparkSession
    body = utf8(F.col("text"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    classes = written(narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("rows")), "shard-rows")
    n = classes.agg(F.sum("rows")).first()[0] or 0
    narrow = repeated(classes, "rows").drop("rows")
    cells = max(1, min(MAX_CELLS, -(-n // cell_rows)))
    cells = max(cells, min(MAX_CELLS, int(spark.conf.get("spark.sql.shuffle.partitions")))) if n else 1
    spread = F.xxhash64(F.lit(seed), *_ROW)
    in_cell = narrow.withColumn("cell", F.pmod(spread, F.lit(cells)).cast("int"))
    counts = {r["cell"]: r["n"] for r in in_cell.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([counts.get(c, 0) for c in range(cells)], shards, seed)

    # A row's place in its cell's permutation falls between two cumulative counts of the cell's matrix row.
    place = F.row_number().over(Window.partitionBy("cell").orderBy(*_order(seed, 1)))
    bounds_schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("bounds", T.ArrayType(T.LongType()))])
    bounds = spark.createDataFrame([(c, row) for c, row in enumerate(np.cumsum(matrix, 1).tolist())], bounds_schema)
    dealt = in_cell.withColumn("place", place).join(F.broadcast(bounds), "cell")  # at most MAX_CELLS rows
    dealt = dealt.withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("place"))).cast("int"))
    dealt = written(dealt.select(*_ROW, "shard"), "shard-dealt")

    # The second permutation orders a shard by another hash: ranges of the hash first, then within a range.
    parts = max(1, min(MAX_CELLS, -(-n // (shards * cell_rows))))
    parts = max(parts, min(MAX_CELLS, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)))
    h = F.xxhash64(F.lit(seed + 2), *_ROW)
    ranged = dealt.withColumn("part", F.pmod(h, F.lit(parts)).cast("int"))
    per_part = ranged.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_part = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*_order(seed, 3)))
    slots = ranged.withColumn("rank", in_part).join(F.broadcast(offsets), ["shard", "part"])  # shards * parts rows
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
