"""Helpers shared by the operators: scratch tables, partition counts, text chunks."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_path, materialize, scratch_path, shared_dir

__all__ = ["ROW", "bit_filter", "drop_path", "load", "materialize", "numbered", "own_names", "partitions", "scratch_path", "shared_dir", "text_chunks", "trimmed", "whole_text", "without"]

ASCII_SPACE = " \t\n\x0b\x0c\r"
ROW = "__row"
FILTER_BITS = 1 << 25


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bit_filter(rows: DataFrame) -> Column:
    """A predicate on ROW that is true for all ROWs in rows and for few others: a bit array of FILTER_BITS bits, however many rows there are.

    With many more rows than bits it holds for nearly all, and nothing is saved.
    """
    place = lambda: F.pmod(F.xxhash64(ROW), F.lit(FILTER_BITS))
    by = rows.select((place() + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in by.collect():  # FILTER_BITS bits at most
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["bucket"] - 1) * own.size : r["bucket"] * own.size] = own
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        x = at.to_numpy()
        return pd.Series(shared.value[x >> 3] >> (x & 7) & 1 == 1)

    return held(place())


def without(held: DataFrame, lost: DataFrame) -> DataFrame:
    """held without the rows whose ROW is in lost; only rows that a bit array cannot rule out are shuffled."""
    maybe = bit_filter(lost)
    return held.where(~maybe).unionByName(held.where(maybe).join(lost.hint("merge"), ROW, "left_anti"))


def own_names(run):
    """run(docs, ...) -> DataFrame, with columns of docs whose names run takes for itself renamed meanwhile."""

    @functools.wraps(run)
    def wrapped(docs: DataFrame, *args, **options):
        taken, other = {c.lower() for c in docs.columns}, {}
        for c in docs.columns:
            if c.lower().startswith((ROW, "_ml_")):
                n = 0
                while (name := f"kept{n}_{c}").lower() in taken:
                    n += 1
                other[c] = name
        named = lambda x: other.get(x, x) if isinstance(x, str) else x
        out = run(docs.withColumnsRenamed(other) if other else docs, *(named(x) for x in args), **{k: named(v) for k, v in options.items()})
        return out.withColumnsRenamed({v: k for k, v in other.items()}) if other and out is not None else out

    return wrapped


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back, with a number of its own for every row in ROW."""
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole_text(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def text_chunks(texts: list, limit: int = 4_000_000):
    """Slices (start, stop) of texts with about limit characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def trimmed(run):
    """run(batches), after which the worker gives freed memory back to the system: a Python worker outlives its stages, and what it holds is missing in the next."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return wrapped
