"""Hard-negative mining: exact, by norm-bucketed search within windows of scores.

Candidates are sorted by norm and cut into blocks, and a block into buckets of BUCKET rows. By
Cauchy-Schwarz no row of a bucket scores above the product of its largest norm and the anchor's,
so an anchor is sent only to blocks, and within them compared only with buckets, that can reach the lower
limit of one of its windows and the score of the last of the rows found for it so far.

First every anchor's positives are searched among the rows of its label, in blocks
sorted by label and norm; their scores give the windows. Then negatives are searched for all windows of an
anchor at once, in blocks sorted by norm alone: the inner products are computed once. Each
block gives at most N_NEGATIVES rows a window, which a window function over the blocks
merges. On vectors of about one length the bounds rule out little, and what is left
are matrix products of all anchors with all rows.

Cases: rows without id or label take no part, nor do vectors that are null, hold a null or a
non-finite component, or leave the range of a double when scaled; shorter vectors count as filled with
zeros; every row is a row of its own, also if it repeats another's id or vector, so two
anchors of one id have their own positives each; a positive with a score below zero has an empty
window (50 s > 95 s); ties go to the smaller id; very frequent vectors are cut into
blocks like any others; a score that is no long is null, its digits are in positive_score_text or
negative_score_text; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, materialize
from .vectors import as_long, by_score, fit, in_blocks, narrow_limit, past_blocks, prepared, score_text, whole_products, wide_key

N_POSITIVES = 5
N_NEGATIVES = 3
LEAST, MOST = 50, 95
EVERY = 50
BUCKET = 2048
ROUNDING = 1 + 1e-9

HITS = "key long, slot int, other_key long, other_id long, score long, wide string"


class NormBuckets:
    """Rows of a block in buckets of descending norm; those too wide for doubles apart."""

    def __init__(self, rows: dict):
        v = rows["v"]
        wide = np.abs(v).max(axis=1, initial=0) > narrow_limit(v.shape[1])
        order = np.argsort(-rows["norm"], kind="stable")
        take = lambda at: (rows["key"][at], rows["vec_id"][at], rows["label"][at], v[at], float(rows["norm"][at].max(initial=0)))
        narrow = order[~wide[order]]
        self.buckets = [take(narrow[i : i + BUCKET]) for i in range(0, narrow.size, BUCKET)]
        self.wide = take(order[wide[order]])
        self.d = v.shape[1]


def best_in(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of every row's k highest scores among ok ones, ties at the last kept."""
    held = np.where(ok, scores, -np.inf)
    if held.shape[1] > k:
        last = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        ok = ok & (held >= last[:, None])
    return np.nonzero(ok)


def cut(row: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int):
    """The k best of every row, ties to the smaller id."""
    order = np.lexsort((keys, ids, -score, row))
    row, score, ids, keys = row[order], score[order], ids[order], keys[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1]) if row.size else np.empty(0, np.int64)
    place = np.arange(row.size) - np.repeat(start, np.diff(np.concatenate([start, [row.size]])))
    kept = place < k
    return row[kept], score[kept], ids[kept], keys[kept]


def search_windows(block: NormBuckets, q: dict, low: list[list], high: list[list], same: bool, k: int):
    """(query, slot, key, id, exact score) of the rows whose score lies in a window, the k best of each; low[i], high[i]: query i's windows.

    same: whether rows of the query's label are searched, or those of other labels. A query never meets its own row.
    """
    n, slots = len(low), max((len(x) for x in low), default=0)
    d = max(block.d, q["v"].shape[1])
    v = fit(q["v"], d)
    wide = np.abs(v).max(axis=1, initial=0) > narrow_limit(d)
    lo, hi = np.full((n, slots), np.inf), np.full((n, slots), -np.inf)
    for i in range(n):
        for s, (a, b) in enumerate(zip(low[i], high[i], strict=True)):
            lo[i, s], hi[i, s] = _double(a), _double(b)
    none = np.empty(0, np.int64)
    found = [(none, np.empty(0), none, none)] * slots
    floor = lo.copy()  # of the window, later of the k-th row found
    for keys, ids, labels, x, norm in block.buckets:
        with np.errstate(invalid="ignore", over="ignore"):
            reach = np.nan_to_num(q["norm"] * norm * ROUNDING, nan=np.inf, posinf=np.inf)
        live = np.flatnonzero(~wide & (reach >= floor.min(axis=1, initial=np.inf)) & (np.isin(q["label"], labels) if same else True))
        if not live.size:
            continue
        scores = v[live] @ fit(x, d).T
        may = (q["label"][live][:, None] == labels) == same
        may &= q["key"][live][:, None] != keys
        for s in range(slots):
            own = np.flatnonzero(reach[live] >= floor[live, s])
            if not own.size:
                continue
            some = scores[own]
            at, col = best_in(some, may[own] & (some >= floor[live[own], s][:, None]) & (some <= hi[live[own], s][:, None]), k)
            row, score, rid, rkey = found[s]
            found[s] = cut(np.concatenate([row, live[own[at]]]), np.concatenate([score, some[at, col]]), np.concatenate([rid, ids[col]]), np.concatenate([rkey, keys[col]]), k)
            row, score = found[s][:2]
            full, counts = np.unique(row, return_counts=True)
            full = full[counts == k]
            floor[full, s] = np.maximum(floor[full, s], score[np.searchsorted(row, full, side="right") - 1])
    for s, (row, score, rid, rkey) in enumerate(found):
        yield from zip(row.tolist(), [s] * row.size, rkey.tolist(), rid.tolist(), (int(x) for x in score), strict=True)
    for i in range(n):  # rows that doubles do not hold, one by one
        for keys, ids, labels, x, _ in ([*block.buckets, block.wide] if wide[i] else [block.wide]):
            at = np.flatnonzero(((labels == q["label"][i]) == same) & (keys != q["key"][i]))
            exact = whole_products(v[i], fit(x, d)[at]) if at.size else []
            for s, (a, b) in enumerate(zip(low[i], high[i], strict=True)):
                inside = sorted((-e, int(ids[j]), int(keys[j])) for e, j in zip(exact, at, strict=True) if a <= e <= b)[:k]
                yield from ((i, s, key, rid, -e) for e, rid, key in inside)


def _double(x) -> float:
    try:
        return float(x)
    except OverflowError:
        return np.inf if x > 0 else -np.inf


def _search(same: bool, k: int):
    def search(block: NormBuckets, q: dict):
        if same:
            low, high = [[-np.inf]] * len(q["key"]), [[np.inf]] * len(q["key"])
        else:
            scores = [[int(s) for s in t.split(",")] for t in q["scores"]]
            low = [[-(-LEAST * s // 100) for s in x] for x in scores]
            high = [[MOST * s // 100 for s in x] for x in scores]
        hits = list(search_windows(block, q, low, high, same, k))
        columns = list(zip(*hits, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(q["key"][list(columns[0])] if hits else [], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()),
                pa.array([as_long(s) for s in columns[4]], pa.int64()), pa.array([wide_key(s) for s in columns[4]], pa.string()),
            ],
            ["key", "slot", "other_key", "other_id", "score", "wide"],
        )

    return search


def _first(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "slot").orderBy(*by_score(), "other_id", "other_key")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and both scores as text); anchors: which rows of vectors are anchors."""
    label = (F.col("label") if label is None else label).cast("long")
    rows = prepared(vectors.where(label.isNotNull()), id_col, vector_col, {"label": label, "anchor": F.coalesce(anchors, F.lit(False))})
    asked = rows.where("anchor").select("key", "vec_id", "norm", "v", "label")
    by_label = in_blocks(rows, [F.col("label"), F.desc("norm")])
    homes = by_label.select("label", "block").distinct()
    positives = past_blocks(by_label, asked.join(homes.hint("shuffle_merge"), "label"), ["label"], ["label"], NormBuckets, _search(True, N_POSITIVES), HITS)
    positives = _first(positives, N_POSITIVES).select("key", F.col("rank").alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), score_text().alias("positive_score_text"))
    positives = materialize(positives, "positives")
    # a score below zero has no window; slots of the others follow the rank
    usable = positives.where(~F.col("positive_score_text").startswith("-"))
    windows = usable.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score_text"))), lambda s: s["positive_score_text"]).alias("scores"))
    least = F.array_min(F.transform("scores", lambda s: s.cast("double"))) * (LEAST / 100)
    windows = windows.select("key", F.concat_ws(",", "scores").alias("scores"), least.alias("least"))
    by_norm = in_blocks(rows, [F.desc("norm")])
    sent = _reached(asked.join(windows, "key"), by_norm)
    found = past_blocks(by_norm.withColumn("scores", F.lit(None).cast("string")), sent, ["label", "scores"], ["key"], NormBuckets, _search(False, N_NEGATIVES), HITS)
    found = _first(found, N_NEGATIVES).select("key", (F.col("slot") + 1).alias("slot"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"), score_text().alias("negative_score_text"))
    named = usable.join(asked.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return found.join(named, ["key", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", "positive_score_text", "negative_score_text"
    )


def _reached(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """asked with the numbers of the blocks that can reach least: those whose largest norm is large enough.

    The largest norms are one number a block, for a block of many megabytes.
    """
    bounds = blocks.groupBy("block").agg(F.max("norm").alias("norm")).collect()
    norms, numbers = np.array([r["norm"] for r in bounds], np.float64), np.array([r["block"] for r in bounds], np.int64)

    @F.pandas_udf("array<int>")
    def reach(norm: pd.Series, least: pd.Series) -> pd.Series:
        with np.errstate(invalid="ignore", over="ignore"):
            most = np.nan_to_num(np.multiply.outer(norm.to_numpy(), norms) * ROUNDING, nan=np.inf, posinf=np.inf)
        return pd.Series([numbers[m >= x].tolist() for m, x in zip(most, least.to_numpy(), strict=True)])

    return asked.withColumn("block", F.explode(reach("norm", "least")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(load(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, label=own)


SQL = """
WITH r AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.k AS ak, a.vec_id AS anchor_id, a.label = b.label AS same, b.k AS bk, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.k <> b.k),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.ak, p.anchor_id, p.place, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.ak, p.place ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.ak = p.ak AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_score::VARCHAR AS positive_score_text, negative_score::VARCHAR AS negative_score_text
FROM n WHERE rank <= 3"""
