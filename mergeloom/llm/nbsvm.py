"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram of 3 to 6 characters, hashed into 2**20
cells, in the lower-cased text whose non-letters are spaces. Training takes at
most TRAIN_ROWS labelled documents, those of the smallest hashes, outside of the
held-out fifth. A feature that separates the labels by less than Z_MIN standard
errors is left out; the others are worth their log-count ratio r, and a logistic
regression with an L2 penalty learns a weight on top of each.

The fit runs in one task over the cells of that bounded sample; the model, of a fixed size, is
then sent to the tasks that score all documents.

Cases: a null text is an empty one and gets the score of the intercept; a document
labelled twice counts as toxic if one label says so; labels without toxic or
doc_id teach nothing; a null doc_id is not held out; with labels of one kind only,
or none, every score is the share of toxic labels (0 without labels, or without
documents that have one); of rows that repeat a doc_id the text that sorts first teaches; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, text_chunks, whole_text

TRAIN_ROWS = 5000
SIZES = (3, 4, 5, 6)
CELLS = 1 << 20
Z_MIN = 4.0
L2 = 1e-3
STEPS = 200
FOLDS = 5

_LETTER = np.array([32 if not chr(c).isalpha() else c for c in range(0x3000)], np.uint32)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def ngram_cells(text: str) -> np.ndarray:
    """The cell of every n-gram of a whole text, repeats included."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 0x3000
    codes = np.where(low, _LETTER[np.where(low, codes, 0)], codes)
    out = []
    h = codes * np.uint32(0x9E3779B1)
    for n in range(2, SIZES[-1] + 1):
        if codes.size < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0xC2B2AE35)
        if n >= SIZES[0]:
            mixed = h ^ (h >> np.uint32(13))
            out.append((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(12))
    return np.concatenate(out).astype(np.int32) if out else np.empty(0, np.int32)


def fit(docs: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of every cell, intercept); docs: the distinct cells of each text."""
    labels = np.asarray(labels, np.float64)
    share = float(labels.mean()) if labels.size else 0.0
    weights = np.zeros(CELLS, np.float32)
    if share in (0.0, 1.0):
        return weights, 40.0 if share else -40.0
    df = [np.zeros(CELLS), np.zeros(CELLS)]
    for cells, y in zip(docs, labels, strict=True):
        df[int(y)][cells] += 1
    n1, n0 = labels.sum(), labels.size - labels.sum()
    p, q = (df[1] + 1) / (n1 + 2), (df[0] + 1) / (n0 + 2)
    both = (df[1] + df[0] + 1) / (labels.size + 2)
    z = (p - q) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero((np.abs(z) >= Z_MIN) & (df[1] + df[0] >= 3))
    ratio = np.log((p / p.sum()) / (q / q.sum()))[chosen]
    column = np.full(CELLS, -1, np.int32)
    column[chosen] = np.arange(chosen.size)
    rows, cols = [], []
    for i, cells in enumerate(docs):
        own = column[cells]
        own = own[own >= 0]
        rows.append(np.full(own.size, i, np.int32))
        cols.append(own)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    values = ratio[cols]
    weight_of = np.where(labels == 1, 0.5 / n1, 0.5 / n0)  # both labels count alike
    w, b = np.full(chosen.size, 0.05), 0.0
    gw, gb = np.full(chosen.size, 1e-8), 1e-8
    for _ in range(STEPS):  # Adagrad on the whole sample
        s = b + np.bincount(rows, w[cols] * values, labels.size)
        err = (1 / (1 + np.exp(-np.clip(s, -40, 40))) - labels) * weight_of
        g = np.bincount(cols, values * err[rows], chosen.size) + L2 * w
        gw += g * g
        gb += err.sum() ** 2
        w -= 0.1 * g / np.sqrt(gw)
        b -= 0.1 * err.sum() / np.sqrt(gb)
    weights[chosen] = w * ratio
    return weights, float(b)


def score(text: str, weights: np.ndarray, intercept: float) -> float:
    cells = ngram_cells(text)
    w = weights[cells]
    hit = np.unique(cells[w != 0])
    return float(1 / (1 + np.exp(-np.clip(intercept + weights[hit].sum(dtype=np.float64), -40, 40))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    taught = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("_ml_id")).agg(F.max("toxic").cast("int").alias("_ml_y"))
    picked = taught.orderBy(F.xxhash64("_ml_id"), "_ml_id").limit(rows)  # bounded by the parameter
    sample = docs.select(F.col(id_col).cast("long").alias("_ml_id"), whole_text(text_col).alias("_ml_text")).join(F.broadcast(picked), "_ml_id")
    sample = sample.groupBy("_ml_id", "_ml_y").agg(F.min("_ml_text").alias("_ml_text"))

    def cells(batches):
        for b in batches:
            found = [np.unique(ngram_cells(t)).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["id", "y", "cells"])

    def run(batches):
        rows = sorted((y, i, c) for b in batches for i, y, c in zip(*(x.to_pylist() for x in b.columns), strict=True))
        weights, intercept = fit([np.frombuffer(c, np.int32) for _, _, c in rows], np.array([y for y, _, _ in rows]))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary()), "intercept": [intercept]})

    found = sample.select("_ml_id", "_ml_y", "_ml_text").mapInArrow(cells, "id long, y int, cells binary")
    model = found.repartition(1).mapInArrow(run, "weights binary, intercept double").first()
    if model is None:  # no partition at all
        return fit([], np.empty(0))
    return np.frombuffer(bytes(model["weights"]), np.float32), model["intercept"]


def classify(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, intercept = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in text_chunks(texts):
                scores = [score(t, weights, intercept) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), held_out(id_col).alias("held_out"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return classify(docs, train(docs, load(spark, sf_dir, "labels")))
