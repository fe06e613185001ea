"""Line deduplication over levelled sorted runs of line hashes.

A store holds runs, each a table of (h, n_docs, last_doc, fresh) sorted by the
128-bit line hash h, in a fixed number of buckets. Every new batch is aggregated, merge-joined with the fresh
rows of all runs, and written as a run of level 0: a hash that no run holds is ``fresh``, an
entry of the store; for others the run has an addition to an entry that an older run holds. So
entries are distinct over the store, and a line's total is its entry and the additions to
it. Once a level holds FANOUT runs they are merged into one run of the next level, where
additions are worked into the entries that are there.

Documents go into batches by the hash of their doc_id, so each batch has all the
rows of a document, and n_docs counts documents exactly. Counting is a partial
aggregation, so a line found everywhere costs one row a task.

Cases: a null or empty text is one empty line; a text of spaces is kept as it is,
for its key is short; rows that repeat a doc_id count as one document and are
treated alike; rows with a null doc_id count as no document and lose the lines
that others hold often enough; very long texts are split whole; dedup_lines keeps further columns whatever
their names are; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, drop_path, load, materialize, own_names, partitions, scratch_path, whole_text

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
RUN_SCHEMA = "h binary, n_docs long, last_doc long, fresh boolean"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 128-bit hash of a line's key, or None for a short key."""
    key = line.strip(ASCII_SPACE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h): every distinct long line of every row."""

    def run(batches):
        for b in batches:
            ids, hashes = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(t) < min_chars:
                    continue
                found = {line_key(x, min_chars) for x in t.split("\n")} - {None}
                ids += [d] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "h"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, h binary")


@contextmanager
def ordered_scans(spark: SparkSession):
    """Within it, Spark trusts the order of bucketed files."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class RunStore:
    """Levelled sorted runs in the shared folder, in a fixed number of buckets by h, so that merging them moves and sorts no run."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or partitions(spark)
        self.levels: list[list[str]] = []
        self.tables: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(self.tables[p]) for level in self.levels for p in level]

    def _write(self, run: DataFrame, level: int) -> None:
        """A sorted file a bucket, under a name in the session's catalog that tells Spark so."""
        path = scratch_path(self.spark, f"run-{level}")
        self.tables[path] = f"mergeloom_run_{uuid.uuid4().hex}"
        dealt = run.select("h", "n_docs", "last_doc", "fresh").repartition(self.buckets, "h").sortWithinPartitions("h")
        with ordered_scans(self.spark):
            dealt.write.bucketBy(self.buckets, "h").sortBy("h").option("compression", "zstd").option("path", path).saveAsTable(self.tables[path])
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, lines: DataFrame) -> None:
        """Add a batch (doc_id, h) as a run of level 0: entries for the hashes that no run holds, additions for the others."""
        batch = lines.groupBy("h").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        self._write(self.merged(batch), 0)
        self.compact()

    def merged(self, batch: DataFrame) -> DataFrame:
        """batch (h, ...) with ``fresh``: whether no run holds h. The batch is dealt and sorted once, the runs are merged as they lie."""
        batch = batch.repartition(self.buckets, "h")
        fresh = F.lit(True)
        for i, r in enumerate(self.runs()):
            held = r.where("fresh").select("h", F.lit(True).alias(f"held{i}"))
            batch = batch.join(held.hint("merge"), "h", "left")
            fresh = fresh & F.col(f"held{i}").isNull()
        return batch.withColumn("fresh", fresh)

    def drop(self, paths: list[str]) -> None:
        for p in paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(p)}")
            drop_path(self.spark, p)

    def close(self) -> None:
        self.drop([p for level in self.levels for p in level])
        self.levels = []

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            paths = self.levels[level]
            if len(paths) >= self.fanout:
                self.levels[level] = []
                self._write(merge_runs([self.spark.table(self.tables[p]) for p in paths]), level + 1)
                self.drop(paths)
            level += 1

    def totals(self) -> DataFrame:
        return merge_runs(self.runs()).where("fresh")


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """One run: entries with the additions to them, and additions whose entry is in none of these runs."""
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.unionByName(r)
    entries = rows.where("fresh").select("h", "n_docs", "last_doc")
    added = rows.where(~F.col("fresh")).groupBy("h").agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later"))
    both = entries.join(added.hint("merge"), "h", "full_outer")
    n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
    return both.select("h", n_docs.alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"), F.col("n_docs").isNotNull().alias("fresh"))


def _strip(min_chars: int):
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def strip(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(texts, drops, strict=True):
            if d is None or not len(d):
                out.append((t, t.count("\n") + 1, 0))
                continue
            lines = t.split("\n")
            gone = {bytes(x) for x in d}
            kept = [x for x in lines if line_key(x, min_chars) not in gone]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return strip


def lines_to_drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_ml_id, _ml_drops): by document, the hashes of the lines that it loses."""
    hashes = line_hashes(docs, id_col, text_col, min_chars)
    staged = materialize(hashes.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).cast("int")), "lines", "batch")
    store = RunStore(docs.sparkSession)
    for b in range(BATCHES):
        store.add(staged.where(F.col("batch") == b).select("doc_id", "h"))
    common = materialize(store.totals().where(F.col("n_docs") >= min_docs).select("h", "last_doc"), "common-lines")
    store.close()
    hits = staged.select("doc_id", "h").join(common, "h").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return hits.groupBy(F.col("doc_id").alias("_ml_id")).agg(F.collect_set("h").alias("_ml_drops"))


@own_names
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of text_col; with counts also ``n_lines`` and ``n_dropped`` (replacing columns so named)."""
    drops = materialize(lines_to_drop(docs, id_col, text_col, min_chars, min_docs), "drops")
    joined = docs.withColumn("_ml_text", whole_text(text_col)).join(drops.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("_ml_id")), "left")
    done = joined.withColumn("_ml_out", _strip(min_chars)("_ml_text", "_ml_drops"))
    columns = {text_col: F.when(F.col(text_col).isNull(), F.lit(None)).otherwise(F.col("_ml_out.text"))}
    if counts:
        columns |= {"n_lines": F.col("_ml_out.n_lines"), "n_dropped": F.col("_ml_out.n_dropped")}
    return done.withColumns(columns).drop("_ml_text", "_ml_id", "_ml_drops", "_ml_out")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
