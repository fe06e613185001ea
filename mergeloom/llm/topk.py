"""Exact top-k by inner product: columnar branch-and-bound.

Candidates lie in vertical layout, one array a dimension. A query's scores are
accumulated block by block of dimensions, heaviest first; after each block the
Cauchy-Schwarz bound on the remaining mass gives every candidate a range, the
k-th best lower end is the threshold, and candidates whose upper end lies below
it are compacted away. The few survivors are scored exactly in integers, as wide as
they have to be.

Queries are a stated set. They stream past blocks of candidates of bounded size (see vectors.py): nothing of
either goes through the driver, and a task holds one block and a batch of queries at a time, however
many there are. Each block gives its k best rows for a query, and a window over the blocks merges them.

Cases: a component x becomes floor(256 * x) in double precision; vectors that are
null, that hold a null, NaN or infinity, or that leave the range of a double when scaled take no part, nor do rows without
vec_id; a shorter vector counts as filled with zeros; rows that repeat id and vector count
once; other rows are rows of their own, whatever their ids: a query meets all but its own, and two queries that share an id have k rows each; ties go to the smaller vec_id; scores
are exact at any width, and one that is no long is null, its digits are in score_text; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load
from .vectors import as_long, by_score, fit, in_blocks, integers, past_blocks, prepared, score_text, whole_products, wide_key

K = 5
EVERY = 50
BLOCK = 16
BLOCK_BYTES = 32 << 20
FLOATS = float(1 << 100)
HITS = "key long, query_id long, vec_id long, score long, wide string"


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of x's rows with q; float64 is exact below 2**53."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.size
    if bound < 2.0**53:
        return (x @ q).astype(np.int64)
    if bound < 2.0**62:
        return (x.astype(np.int64) * q.astype(np.int64)).sum(axis=1)
    return integers(x) @ integers(q[None])[0] if x.size else np.zeros(len(x), object)


class VerticalBlock:
    """Candidates by dimension, with the norms of what is left after each block of dimensions; those beyond FLOATS apart, row by row."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK):
        far = np.abs(rows).max(axis=1, initial=0) > FLOATS
        self.far = keys[far], ids[far], rows[far]
        self.keys, self.ids, self.block, rows = keys[~far], ids[~far], block, rows[~far]
        weight = (rows**2).sum(axis=0)
        self.order = np.argsort(-weight, kind="stable")
        self.columns = np.ascontiguousarray(rows[:, self.order].T)
        squares = self.columns**2
        self.norm = np.sqrt(squares.sum(axis=0))
        self.rest = [np.sqrt(squares[b:].sum(axis=0)) for b in range(block, rows.shape[1] + block, block)]

    def all_best(self, key: int, q: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """The ids and exact scores of the k best rows for q, ties to the smaller id; its own row, of that key, is none of them."""
        far_keys, far_ids, far = self.far
        if np.abs(q).max(initial=0) > FLOATS:
            ids, scores, keys = self.ids.tolist(), whole_products(q[self.order], self.columns.T), self.keys
        else:
            ids, scores, keys = *(x.tolist() for x in self.best(key, q, k)), None
        found = [(-int(s), i) for s, i, own in zip(scores, ids, [None] * len(ids) if keys is None else keys.tolist(), strict=True) if own != key]
        found += [(-s, i) for s, i, own in zip(whole_products(q, far), far_ids.tolist(), far_keys.tolist(), strict=True) if own != key]
        found = sorted(found)[:k]
        return [i for _, i in found], [-s for s, _ in found]

    def best(self, key: int, q: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best rows for q, ties to the smaller id; rows below least may be left out."""
        q = q[self.order]
        alive = np.flatnonzero(self.keys != key)
        part, length = None, float(np.sqrt((q**2).sum()))
        for n, b in enumerate(range(0, q.size, self.block)):
            take = slice(b, b + self.block)
            columns = self.columns[take] if part is None and alive.size == self.ids.size else self.columns[take][:, alive]
            add = q[take] @ columns
            part = add if part is None else part + add
            slack = float(np.sqrt((q[b + self.block :] ** 2).sum())) * self.rest[n][alive]
            slack = slack * (1 + 1e-9) + 1e-12 * length * self.norm[alive] + 1e-3  # rounding of the bound itself
            if alive.size > k or least > -np.inf:
                floor = max(least, np.partition(part - slack, alive.size - k)[alive.size - k] if alive.size > k else -np.inf)
                keep = part + slack >= floor
                alive, part = alive[keep], part[keep]
            if alive.size <= 4 * k:
                break
        return first(self.ids[alive], exact_scores(q, self.columns.T[alive]), k)


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of ids and scores, ties to the smaller id."""
    if scores.dtype == object:
        order = np.array(sorted(range(ids.size), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    else:
        order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _block(rows: dict) -> VerticalBlock:
    return VerticalBlock(rows["key"], rows["vec_id"], rows["v"])


def _search(k: int):
    def search(block: VerticalBlock, q: dict):
        d = max(block.order.size, q["v"].shape[1])
        if d > block.order.size:  # queries of more dimensions: the rows have zeros there
            q = q | {"v": q["v"][:, : block.order.size]}
        rows = []
        for key, own, query_id, v in zip(q["key"].tolist(), q["own"].tolist(), q["vec_id"].tolist(), fit(q["v"], block.order.size), strict=True):
            rows += [(key, query_id, i, as_long(s), wide_key(s)) for i, s in zip(*block.all_best(own, v, k), strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "query_id", "vec_id", "score", "wide"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, score_text): the k best rows of vectors for each row of queries."""
    shape = [F.col(id_col).alias(id_col), F.col(vector_col).cast("array<double>").alias(vector_col)]
    given = lambda df: prepared(df.select(*shape).distinct(), id_col, vector_col, {"hash": F.xxhash64(vector_col)})
    rows, asked = given(vectors), given(queries)
    same = ["vec_id", "v", "hash"]
    asked = asked.join(rows.select(*same, F.col("key").alias("own")), same, "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    blocks = in_blocks(rows, [F.xxhash64("key")], BLOCK_BYTES).withColumn("own", F.lit(-1).cast("long"))
    homes = blocks.select("block").distinct().agg(F.collect_list("block").alias("all"))  # one number for many megabytes of vectors
    sent = asked.join(F.broadcast(homes), how="cross").withColumn("block", F.explode("all"))
    hits = past_blocks(blocks, sent, ["own"], ["key"], _block, _search(k), HITS)
    order = Window.partitionBy("key").orderBy(*by_score(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", score_text().alias("score_text"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))
