"""Shared helpers: settled tables, joins with a key table, names that cannot clash."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20


def settled(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write a derived table as Parquet to the shared folder and read it back, in row groups of about ``row_group`` bytes.

    Later steps read it from there, with column pruning, whichever executors are
    lost meanwhile; values such as row ids stay what they were when written.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let the driver collect its garbage now: plans, broadcasts and shuffle files of finished steps.

    Spark drops them only once their handles are collected, and a heap that is left to
    itself grows to its limit through a long chain of jobs however little of it is live.
    """
    spark.sparkContext._jvm.System.gc()


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def named(columns: Sequence[str]) -> list[Column]:
    """Columns by their exact names, dots and quotes included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def lookup(left: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str], salt: Column, salts: int = 32) -> DataFrame:
    """Add ``values`` of the settled ``table`` (one row per key, nulls are keys too) to every row of ``left``.

    A small table, by its counted rows and measured bytes, is broadcast.  A larger
    one is copied ``salts`` times and joined on (key, salt), so that the rows of a
    hot key are spread.  Both ways give the same rows.
    """
    lent = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(64))
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(lent), F.lit(0))).first()
    small = table.select(*[F.col(k).alias(f"_llm_k{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"_llm_v_{v}") for v in values])
    match = [same(F.col(k), F.col(f"_llm_k{i}")) for i, k in enumerate(keys)]
    gone = [f"_llm_k{i}" for i in range(len(keys))]
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        small = F.broadcast(small)
    else:
        small = small.withColumn("_llm_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        left = left.withColumn("_llm_t", F.pmod(salt, F.lit(salts)).cast("int"))
        match.append(F.col("_llm_t") == F.col("_llm_s"))
        gone += ["_llm_s", "_llm_t"]
    on = match[0]
    for m in match[1:]:
        on = on & m
    return left.join(small, on, "left").drop(*gone).withColumnsRenamed({f"_llm_v_{v}": v for v in values})


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def numbers(df: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Long columns of a table of bounded length as arrays on the driver, moved as packed bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(i).to_numpy().astype(np.int64).tobytes()], pa.binary()) for i in range(len(columns))], list(columns))

    rows = df.select(*columns).mapInArrow(pack, ", ".join(f"{c} binary" for c in columns)).collect()
    return [np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r[i], np.int64) for r in rows]]) for i in range(len(columns))]
