"""Mixing sources to target weights by the cube method (operator 6).

Every document of a source is wanted ``target / source size`` times: the whole part is taken for certain, the
fraction is an inclusion probability. A flight moves the probabilities of three documents at a time along the
direction that leaves both the expected number of words and of documents unchanged, until one of them is 0 or 1.
Flights run within hashed blocks of a source's documents of like size; what a block leaves open (``LEFT`` documents at
most) meets in wider blocks until one block is left for each source and class of sizes. The open documents of a
source, a dozen of each size class, are the landing problem: they are rounded from large to small, each so that the
sum of words comes nearest to the target, and smaller ones make good what larger ones missed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.llm._common import repeated, table, utf8
from wayfarer.session import written

CAP = 3
BLOCK_ROWS = 2_000
FAN_IN = 1_000
#: Documents of each size class that a flight leaves to the landing.
LEFT = 12
SEED = 61
_EDGE = 1e-9


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources by code point, null last, weigh 1, 2, 3 in turn. A source is full (target three times its size) if it
    is so even when all sources of a lower size per weight are; running sums in that order find the full ones.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", (CAP * F.col("source_size")).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    sums = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("caps"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("ws"),
        F.sum("w").over(everything).alias("all_w"),
        F.sum(F.col("source_size").cast("double")).over(everything).alias("all_size"),
    )
    share = F.col("w") * F.greatest(F.col("all_size") - F.col("caps"), F.lit(0.0)) / (F.col("all_w") - F.col("ws"))
    full = sums.withColumn("full", F.col("cap") <= share)
    rest_w = F.col("all_w") - F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(everything)
    rest = F.col("all_size") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * rest / F.nullif(rest_w, F.lit(0.0))))
    return full.select("source", "source_size", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int = LEFT) -> np.ndarray:
    """Move probabilities to 0 or 1, all but ``leave`` at most, keeping their sum and their size-weighted sum."""
    p = p.astype(float).copy()
    undecided = int(((p > _EDGE) & (p < 1 - _EDGE)).sum())
    live: list[int] = []
    coins = rng.random(2 * len(p) + 4)
    toss = 0
    queue = iter(range(len(p)))
    while True:
        if undecided <= leave:
            return p
        while len(live) < 3:
            nxt = next(queue, None)
            if nxt is None:
                break
            if _EDGE < p[nxt] < 1 - _EDGE:
                live.append(nxt)
            else:
                p[nxt] = round(p[nxt])
        if len(live) == 3:
            i, j, k = live
            u = [size[k] - size[j], size[i] - size[k], size[j] - size[i]]
            if not any(u):
                u = [1, -1, 0]
        elif len(live) == 2 and size[live[0]] == size[live[1]]:
            u = [1, -1]
        else:
            return p
        up = min((1 - p[x] if d > 0 else p[x]) / abs(d) for x, d in zip(live, u, strict=True) if d)
        down = min((p[x] if d > 0 else 1 - p[x]) / abs(d) for x, d in zip(live, u, strict=True) if d)
        step = up if coins[toss % len(coins)] * (up + down) < down else -down
        toss += 1
        for x, d in zip(live, u, strict=True):
            p[x] += step * d
            if p[x] < _EDGE:
                p[x] = 0.0
            elif p[x] > 1 - _EDGE:
                p[x] = 1.0
        undecided -= sum(not 0 < p[x] < 1 for x in live)
        live = [x for x in live if 0 < p[x] < 1]


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the open probabilities, given from large to small, to stay near the sums of words and documents."""
    p = p.copy()
    words = count = 0.0
    for i in np.flatnonzero((p > 0) & (p < 1)):
        misses = [(abs(words + (x - p[i]) * size[i]), abs(count + x - p[i]), x) for x in (0, 1)]
        x = min(misses)[2]
        words, count, p[i] = words + (x - p[i]) * size[i], count + x - p[i], x
    return p


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["size", "order", "doc_id", "text_crc32"], ascending=[False, True, True, True], na_position="last")


def _fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = _ordered(rows)
    rng = np.random.default_rng([SEED, hash_of(key), len(rows)])
    return rows.assign(p=flight(rows["p"].to_numpy(), rows["size"].to_numpy(np.int64).astype(float), rng))


def _land(rows: pd.DataFrame) -> pd.DataFrame:
    rows = _ordered(rows)
    return rows.assign(p=landing(rows["p"].to_numpy(), rows["size"].to_numpy(np.int64).astype(float)))


def hash_of(key: tuple) -> int:
    """A small number from a group's key, alike in every process."""
    value = 17
    for part in key:
        for byte in str(part).encode():
            value = (value * 257 + byte) % 2_147_483_629
    return value


_UNIT = "source string, doc_id long, text_crc32 long, size long, p double, order long, class int, block long"


_SAME = ["source", "doc_id", "text_crc32", "size"]


def _same_unit(prefix: str = "_") -> Column:
    """Null-safe equality of the columns that tell units apart and their prefixed copies."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in _SAME))


def mixed_units(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``source, doc_id, text_crc32, size, rows, source_size, target, whole, extra``, one row for equal rows of ``docs``.

    Each of ``rows`` equal rows is taken ``whole`` times, and ``extra`` of them once more. The draw of equal rows is a number:
    their whole part is sure and what is left is one probability, so however many there are, they are one unit of a flight.
    """
    body = utf8(F.col("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.crc32(body).alias("text_crc32"))
    units = written(rows.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("rows")), "mix-rows")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(sizes.select("source", "source_size")).withColumnRenamed("source", "s")
    plan = sizes.join(targets.drop("source_size"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "n")
    plan = written(plan, "mix-plan")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("want", F.least(wanted, F.lit(float(CAP))))
    units = units.withColumn("whole", F.floor(F.col("want") + F.lit(_EDGE)).cast("int"))
    units = units.withColumn("more", F.col("rows") * F.greatest(F.col("want") - F.col("whole"), F.lit(0.0)))
    units = units.withColumn("sure", F.floor(F.col("more") + F.lit(_EDGE)))
    like = F.when(F.col("size") > 0, F.floor(F.log2(F.greatest("size", F.lit(1))) / 2)).otherwise(F.lit(-1)).cast("int")
    units = units.select("*", F.greatest(F.col("more") - F.col("sure"), F.lit(0.0)).alias("p"), F.xxhash64(F.lit(SEED), "doc_id", "text_crc32", "size").alias("order"), like.alias("class"))
    blocks = F.ceil(F.col("n") / F.lit(block_rows))
    units = written(units.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "text_crc32", "size"), blocks)), "mix-units")
    most = plan.agg(F.max("n")).first()[0] or 0
    n_blocks = max(1, -(-most // block_rows))

    open_ = units.where((F.col("p") > _EDGE) & (F.col("p") < 1 - _EDGE)).select(*[c.split()[0] for c in _UNIT.split(", ")])
    decided: list[DataFrame] = []
    while True:
        flown = written(open_.groupBy("source", "class", "block").applyInPandas(_fly, _UNIT), "mix-flight")
        decided.append(flown.where("p = 0 OR p = 1"))
        open_ = flown.where("p > 0 AND p < 1").withColumn("block", F.floor(F.col("block") / F.lit(FAN_IN)))
        if n_blocks == 1:
            break
        n_blocks = -(-n_blocks // FAN_IN)
    decided.append(written(open_.groupBy("source").applyInPandas(_land, _UNIT), "mix-landing"))
    drawn = reduce(DataFrame.unionByName, decided).where("p = 1").select(*[F.col(c).alias(f"_{c}") for c in _SAME], F.lit(1).alias("drawn"))
    extra = F.col("sure") + F.coalesce("drawn", (F.col("p") >= 1 - _EDGE).cast("int"))
    return units.join(drawn, _same_unit(), "left").select(*_SAME, "rows", "source_size", "target", "whole", extra.cast("long").alias("extra"))


def mix(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, source, text_crc32, size, source_size, target, copies, taken`` for every row of ``docs``.

    Null and empty texts have no words and null sources form one source, the last. A source without words has target 0 and
    takes nothing; an empty table gives no rows. Repeated rows are documents of their own. A rerun draws alike,
    since draws depend on hashes of rows only. Documents are taken whole, ``copies`` (0 to 3) times, however long; columns
    other than ``doc_id``, ``text`` and ``source`` are not read.
    """
    units = repeated(written(mixed_units(docs, block_rows), "mixed"), "rows")
    out = units.withColumn("copies", F.col("whole") + (F.col("copy") < F.col("extra")).cast("int"))
    return out.select("doc_id", "source", "text_crc32", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


#: Buckets into which the rows of one unit are dealt to be numbered.
_BUCKETS = 256


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix has them: each row as many times as it is taken, with all its columns, whatever their names.

    Null, empty and very long texts, null ids and an empty table go as in :func:`mix`. Rows that agree in id, source and text
    may differ in other columns; they are put in the order of a hash of all columns, and the first of them are taken once
    more. Rows that agree in everything are counted, so they take no order.
    """
    units = written(mixed_units(docs), "mixed").where("whole > 0 OR extra > 0")
    units = units.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("text_crc32").alias("_crc"), "rows", "whole", "extra")
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("src"), F.crc32(utf8(F.col("text"))).alias("crc"), F.struct("*").alias("doc"))
    joined = whole.join(units, F.col("id").eqNullSafe(F.col("_id")) & F.col("src").eqNullSafe(F.col("_src")) & (F.col("crc") == F.col("_crc")))
    joined = joined.select("id", "src", "crc", "doc", "rows", "whole", "extra")
    once = joined.where("rows = 1").select("doc", (F.col("whole") + F.col("extra")).alias("times"))
    unit = ["id", "src", "crc"]
    variants = joined.where("rows > 1").groupBy(*unit, "doc", "whole", "extra").agg(F.count(F.lit(1)).alias("n"))
    variants = variants.withColumns({"h": F.xxhash64("doc"), "bucket": F.pmod(F.xxhash64("doc"), F.lit(_BUCKETS))})
    per = variants.groupBy(*unit, "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*unit).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(*[F.col(c).alias(f"_{c}") for c in [*unit, "bucket"]], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*unit, "bucket").orderBy("h", F.to_json("doc")).rowsBetween(Window.unboundedPreceding, -1)
    placed = variants.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = placed.join(starts, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*unit, "bucket"])))
    first = F.col("start") + F.col("ahead")
    again = placed.select("doc", (F.col("whole") * F.col("n") + F.greatest(F.least(first + F.col("n"), F.col("extra")) - first, F.lit(0))).alias("times"))
    most = repeated(written(again.where("times > 0"), "mixed-again"), "times").select("doc.*")
    return once.where("times > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc.*").unionByName(most)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
