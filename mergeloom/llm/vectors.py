"""Integer vectors: scaling, exact inner products, and streams of queries past blocks of candidates.

Candidates are dealt by a sort into blocks of about BLOCK_BYTES, each of which one task holds at a
time. Queries, a stated set, are sent to the blocks that they can reach, and
stream past them behind the candidates of a block: one shuffle and one sort, nothing through
the driver, and memory bounded by a block, however many rows there are on either side.

A component x becomes floor(256 * x) in double precision. Inner products are exact: in
doubles below 2**53, else in integers of any width. A score that is no long is carried as text that
sorts as the number does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

SCALE = 256
BLOCK_BYTES = 32 << 20
BATCH = 256
LONG = 1 << 63

_TURNED = str.maketrans("0123456789", "9876543210")


def scaled_lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which lists take part, lengths of these, their scaled components one after the other)."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * SCALE)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ok = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    sizes = np.diff(offsets)
    return ok, sizes[ok], values[np.repeat(ok, sizes)]


def prepared(df: DataFrame, id_col: str, vector_col: str, more: dict[str, Column] | None = None) -> DataFrame:
    """(key, vec_id, v, norm, more) of the rows that take part, written to the shared folder; v: scaled components as doubles, key: the row's own number.

    Rows without id take no part, nor do vectors that are null, hold a null, NaN or infinity, or
    leave the range of a double when they are scaled.
    """
    more = more or {}
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), *(c.alias(k) for k, c in more.items())).where("vec_id IS NOT NULL AND v IS NOT NULL")

    names = list(more)

    def run(batches):
        for b in batches:
            ok, sizes, values = scaled_lists(b.column(1))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            with np.errstate(over="ignore"):
                norm = np.sqrt(np.bincount(np.repeat(np.arange(sizes.size), sizes), values**2, sizes.size))
            packed = pa.Array.from_buffers(pa.large_binary(), sizes.size, [None, pa.py_buffer((ends * 8).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())])
            kept = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), packed.cast(pa.binary()), pa.array(norm, pa.float64()), *(b.column(2 + i).filter(kept) for i in range(len(names)))], ["vec_id", "v", "norm", *names])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join(["vec_id long", "v binary", "norm double", *(f"{k} {kinds[k]}" for k in more)]))
    return materialize(out.withColumn("key", F.monotonically_increasing_id()), "vectors")


def in_blocks(rows: DataFrame, order: list[Column], block_bytes: int | None = None) -> DataFrame:
    """rows of prepared() dealt by a sort into blocks of about block_bytes (BLOCK_BYTES), numbered in that order by the column block."""
    size = rows.agg(F.sum(F.octet_length("v") + 64).alias("n")).first()["n"] or 0
    n = max(partitions(rows.sparkSession), -(-size // (block_bytes or BLOCK_BYTES)))
    return materialize(rows.repartitionByRange(n, *order, "key").withColumn("block", F.spark_partition_id()), "blocks")


def past_blocks(candidates: DataFrame, queries: DataFrame, more: list[str], order: list[str], block_of, search, schema: str) -> DataFrame:
    """What search yields for the queries (block, key, vec_id, norm, v, more) that stream past each block.

    block_of(rows) makes a block of a dict of columns; search(block, rows) takes at most BATCH queries.
    """
    names = ["key", "vec_id", "norm", "v", *more]
    both = candidates.select("block", F.lit(0).alias("side"), *names).unionByName(queries.select("block", F.lit(1).alias("side"), *names))
    dealt = both.repartition(_blocks(candidates), "block").sortWithinPartitions("block", "side", *order)

    def run(batches):
        current, held, block = None, [], None
        for b in batches:
            at = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) * 2 + b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), at.size] if at.size else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(i, j - i)
                if at[i] // 2 != current:
                    current, held, block = int(at[i] // 2), [], None
                if at[i] % 2 == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    block, held = block_of(columns_of(held, names)), []
                if block is not None:
                    for k in range(0, j - i, BATCH):
                        yield from search(block, columns_of([part.slice(k, BATCH)], names))

    return dealt.mapInArrow(run, schema)


def _blocks(candidates: DataFrame) -> int:
    return (candidates.agg(F.max("block")).first()[0] or 0) + 1


def columns_of(batches: list[pa.RecordBatch], names: list[str]) -> dict:
    """Columns by name as NumPy arrays; v as a matrix, shorter rows filled with zeros."""
    table = pa.Table.from_batches(batches).combine_chunks()
    out = {n: table.column(n).to_numpy(zero_copy_only=False) for n in names if n != "v"}
    rows = [np.frombuffer(x, np.float64) for x in table.column("v").to_pylist()]
    d = max((r.size for r in rows), default=0)
    out["v"] = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        out["v"][i, : r.size] = r
    return out


def fit(m: np.ndarray, d: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, d - m.shape[1]))) if m.shape[1] < d else m


def narrow_limit(d: int) -> float:
    """Rows whose components stay below it have inner products that doubles hold exactly."""
    return float(np.floor(np.sqrt(2.0**53 / max(d, 1))))


def integers(rows: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape)


def whole_products(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Exact inner products of x's rows with q, of any width."""
    if not x.size:
        return [0] * len(x)
    a = [int(v) for v in q]
    return [sum(s * int(v) for s, v in zip(a, r, strict=True) if s) for r in x]


def wide_key(score: int) -> str | None:
    """None for a long; else a text that sorts as the numbers do."""
    if -LONG <= score < LONG:
        return None
    digits = str(abs(score))
    text = f"{len(digits):05d}{digits}"
    return f"+{text}" if score > 0 else "-" + text.translate(_TURNED)


def as_long(score: int) -> int | None:
    return score if -LONG <= score < LONG else None


def by_score(score: str = "score", wide: str = "wide") -> list[Column]:
    """Descending order of exact scores."""
    sign = F.coalesce(F.when(F.col(wide).startswith("+"), 1).when(F.col(wide).isNotNull(), -1), F.lit(0))
    return [F.desc(sign), F.desc(F.coalesce(F.col(wide), F.lit(""))), F.desc(score)]


def score_text(score: str = "score", wide: str = "wide") -> Column:
    """The exact score as text."""
    digits = F.substr(F.col(wide), F.lit(7))
    return F.coalesce(F.col(score).cast("string"), F.when(F.col(wide).startswith("+"), digits).otherwise(F.concat(F.lit("-"), F.translate(digits, "0123456789", "9876543210"))))
