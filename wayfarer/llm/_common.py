"""What the training-data operators share: byte-bounded Arrow batches, table access, packed columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to a Python worker; a longer single row is a batch of its own.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, n_bytes: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches of this session by bytes, since documents differ in length by orders."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.encode(text, "utf-8"), F.lit(b""))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary column, empty for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift a function of one Arrow batch to the iterator form ``mapInArrow`` wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return run


def planes(values: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane: high bytes that are mostly zero then compress away."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


#: Copies of a row that one task makes.
CHUNK_COPIES = 10_000


def repeated(rows: DataFrame, n: str, chunk: int = CHUNK_COPIES) -> DataFrame:
    """Each row as often as its column ``n`` says, numbered from 0 in ``copy``; copies beyond ``chunk`` are dealt to other tasks.

    ``rows`` is read twice, so it should be a written table.
    """
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = F.col(n).cast("long")
    few = rows.where(count.between(1, chunk)).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    parts = rows.where(count > chunk).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / chunk))))
    dealt = parts.repartition(spread, "_chunk", n)
    first = F.col("_chunk") * chunk
    many = dealt.withColumn("copy", F.explode(F.sequence(first, F.least(first + chunk, count) - 1))).drop("_chunk")
    return few.unionByName(many)
