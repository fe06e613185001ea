"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, of order 4: an n-gram of characters is one long of
15 bits a symbol. The characters that occur are numbered, the most frequent first;
those beyond the numbers there are (about 30,000) are spelled in two symbols kept
for that, so different characters always stay different. Trusted text is that of
documents labelled as good. Its n-grams are counted by partial
aggregation; lower orders take continuation counts; discounts come from the counts
of counts.

The distinct n-grams of all documents then meet the model in sharded joins, one
set of joins an order, which give every distinct n-gram its log-probability. The
HEAD most frequent of them, a table of bounded size, go to the tasks that rescan
the texts; the n-grams of a document that are not in it are joined by key instead,
so every character is scored whatever the number of distinct n-grams.

One in FOLDS trusted texts, by the hash of the text, is kept out of the training text, with all its
copies; so the choice does not depend on ids or on how rows are laid out. A
document is rejected if its nats a character exceed the QUANTILE of these unseen documents of
its language by MARGIN, plus SHORT / sqrt(characters), as few characters say little. Languages
without unseen trusted documents take the quantile over all of them.

Cases: null and empty texts have no characters, a perplexity of 1 and stay; a null
language is one of its own; rows that repeat a doc_id are scored one by one; very long texts are scored whole; further columns are ignored, and keep_good returns them
whatever their names are; without
trusted text, or without unseen trusted documents, nothing is rejected; an empty table gives
no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, load, materialize, numbered, own_names, text_chunks, trimmed, whole_text, without

ORDER = 4
LANGUAGES = 10_000
BITS = 15
MASK = (1 << BITS) - 1
START = 2
LEAD, TRAIL = MASK + 1 - 1088 - 1024, MASK + 1 - 1024  # the symbols that spell a character: its code point over 1024, and the rest
SINGLE = LEAD  # symbols below stand for a character each, but for START
SPELLED = 0xFFFF
HEAD = 1 << 19
CHUNK = 1_000_000
QUANTILE = 0.99
MARGIN = 0.05
FOLDS = 5
SHORT = 2.0


def symbol_table(points: np.ndarray) -> np.ndarray:
    """By code point, its symbol: the first of points take one each, all others the mark SPELLED."""
    table = np.full(0x110000, SPELLED, np.uint16)
    points = points[: SINGLE - 1]
    table[points] = np.delete(np.arange(SINGLE), START)[: points.size]
    return table


def plain_table() -> np.ndarray:
    """Code points that are symbols as they are, as far as these go."""
    table = np.full(0x110000, SPELLED, np.uint16)
    table[:SINGLE] = np.arange(SINGLE)
    table[START] = SPELLED
    return table


_PLAIN = plain_table()


def packed_ngrams(text: str, table: np.ndarray | None = None) -> np.ndarray:
    """The n-gram that ends at each symbol."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    own = (_PLAIN if table is None else table)[points]
    wide = own == SPELLED
    own = own.astype(np.int64)
    if wide.any():
        at = np.arange(own.size) + np.cumsum(wide) - wide
        own = np.repeat(own, 1 + wide)
        own[at[wide]], own[at[wide] + 1] = LEAD + (points[wide] >> 10), TRAIL + (points[wide] & 1023)
    codes = np.concatenate([np.full(ORDER - 1, START, np.int64), own])
    n = codes.size - ORDER + 1
    key = codes[:n].copy()
    for i in range(1, ORDER):
        key <<= BITS
        key |= codes[i : n + i]
    return key


def common_points(texts: DataFrame) -> np.ndarray:
    """The code points of a one-column table of texts, most frequent first."""

    def run(batches):
        n = np.zeros(0x110000, np.int64)
        for b in batches:
            column = b.column(0).to_pylist()
            for i, j in text_chunks(column, CHUNK):
                own = np.bincount(np.frombuffer("".join(column[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32))
                n[: own.size] += own
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["point", "n"])

    rows = texts.mapInArrow(trimmed(run), "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).collect()  # one row a character
    return np.array([r["point"] for r in sorted(rows, key=lambda r: (-r["n"], r["point"]))], np.int64)


def count_ngrams(texts: DataFrame, shared=None) -> DataFrame:
    """(key, n) of a one-column table of texts; shared: the broadcast table of symbols."""

    def run(batches):
        table = None if shared is None else shared.value
        for b in batches:
            column = b.column(0).to_pylist()
            for i, j in text_chunks(column, 2 * CHUNK):
                keys, n = np.unique(np.concatenate([packed_ngrams(t, table) for t in column[i:j]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    return texts.mapInArrow(trimmed(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    of = {r["n"]: r["c"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
    n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


def log_probabilities(trusted: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, lp): the log-probability of the last character of every distinct n-gram in asked, given the others.

    trusted: (key, n), the model's counts of the highest order.
    """
    grams = {ORDER: trusted}
    for o in range(ORDER - 1, 0, -1):
        types = grams[o + 1].select((F.col("key").bitwiseAND(F.lit((1 << BITS * o) - 1))).alias("key"))
        grams[o] = materialize(types.groupBy("key").agg(F.count("*").alias("n")), f"grams-{o}")
    below = None
    for o in range(1, ORDER + 1):
        counts = grams[o]
        d1, d2, d3 = discounts(counts)
        taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        seen = counts.select("key", (F.col("n") - taken).alias("rest"))
        contexts = counts.select(F.shiftright("key", BITS).alias("context"), "n", taken.alias("d")).groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("off"))
        wanted = asked.select(F.col("key").bitwiseAND(F.lit((1 << BITS * o) - 1)).alias("key")).distinct()
        wanted = wanted.withColumn("context", F.shiftright("key", BITS)).withColumn("shorter", F.col("key").bitwiseAND(F.lit((1 << BITS * (o - 1)) - 1)))
        joined = wanted.join(seen, "key", "left").join(contexts, "context", "left")
        if below is None:
            joined = joined.withColumn("p_below", F.lit(1.0 / (MASK + 1)))
        else:
            joined = joined.join(below.select(F.col("key").alias("shorter"), F.col("p").alias("p_below")), "shorter")
        p = F.when(F.col("total").isNull(), F.col("p_below")).otherwise((F.coalesce("rest", F.lit(0.0)) + F.col("off") * F.col("p_below")) / F.col("total"))
        below = materialize(joined.select("key", p.alias("p")), f"p-{o}")
    return below.select("key", F.log("p").alias("lp"))


def _head_cut(counts: DataFrame, limit: int) -> int:
    """The smallest count such that at most limit n-grams have it; from a histogram of at most a few hundred bins."""
    # bins of one count up to 64, then 8 a doubling
    bin_ = F.when(F.col("n") < 64, F.col("n")).otherwise(64 + F.floor((F.log2("n") - 6) * 8)).cast("int")
    bins = sorted(((r["bin"], r["c"], r["low"]) for r in counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("n").alias("low")).collect()), reverse=True)
    total, cut = 0, None
    for _, c, low in bins:
        total += c
        if total > limit:
            break
        cut = low
    return cut if cut is not None else 1 << 62


def _scan(shared, symbols):
    def run(batches):
        keys, lps = shared.value
        table = symbols.value
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in text_chunks(texts, CHUNK):
                sums, tail_keys, tail_counts = [], [], []
                grams = [packed_ngrams(t, table) for t in texts[i:j]]
                sizes = np.array([g.size for g in grams])
                flat = np.concatenate(grams)
                if keys.size:
                    at = np.searchsorted(keys, flat)
                    at[at == keys.size] = 0
                    hit = keys[at] == flat
                    lp = np.where(hit, lps[at], 0.0)
                else:
                    hit, lp = np.zeros(flat.size, bool), np.zeros(flat.size)
                ends = np.cumsum(sizes)
                total = np.concatenate([[0.0], np.cumsum(lp)])
                missed = np.flatnonzero(~hit)
                cuts = np.searchsorted(missed, np.concatenate([[0], ends]))
                for n, (e, s) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                    sums.append(float(total[e] - total[e - s]))
                    k, c = np.unique(flat[missed[cuts[n] : cuts[n + 1]]], return_counts=True)
                    tail_keys.append(k)
                    tail_counts.append(c)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), b.column(3).slice(i, j - i), pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array(sums, pa.float64()), pa.array(tail_keys, pa.list_(pa.int64())), pa.array(tail_counts, pa.list_(pa.int64()))],
                    ["doc_id", "lang", "unseen", "chars", "head_lp", "tail_keys", "tail_counts"],
                )

    return run


def perplexities(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", head: int = HEAD) -> DataFrame:
    """(doc_id, lang, unseen, chars, nats): nats is the cross entropy a character under the model of the trusted documents that are not unseen."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("text"))
    symbols = spark.sparkContext.broadcast(symbol_table(common_points(rows.select("text"))))
    rows = rows.withColumn("unseen", F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0)
    trusted = materialize(count_ngrams(rows.where(~F.col("unseen")).join(trusted_ids, "doc_id", "left_semi").select("text"), symbols), "trusted-grams")
    asked = materialize(count_ngrams(rows.select("text"), symbols), "asked-grams")
    lp = log_probabilities(trusted, asked)
    lp = materialize(asked.join(lp, "key"), "lp")
    top = lp.where(F.col("n") >= _head_cut(asked, head)).select("key", "lp").toPandas().sort_values("key")  # at most head rows
    shared = spark.sparkContext.broadcast((top["key"].to_numpy(np.int64), top["lp"].to_numpy(np.float64)))
    scanned = rows.select("doc_id", "lang", "text", "unseen").mapInArrow(trimmed(_scan(shared, symbols)), "doc_id long, lang string, unseen boolean, chars long, head_lp double, tail_keys array<long>, tail_counts array<long>")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    pairs = scanned.select("row", F.explode(F.arrays_zip("tail_keys", "tail_counts")).alias("t")).select("row", F.col("t.tail_keys").alias("key"), F.col("t.tail_counts").alias("c"))
    tails = pairs.join(lp.select("key", "lp"), "key").groupBy("row").agg(F.sum(F.col("c") * F.col("lp")).alias("tail_lp"))
    total = F.col("head_lp") + F.coalesce("tail_lp", F.lit(0.0))
    return scanned.join(tails, "row", "left").select("doc_id", "lang", "unseen", "chars", F.when(F.col("chars") == 0, 0.0).otherwise(-total / F.col("chars")).alias("nats"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) for every row of docs; threshold is in nats a character."""
    trusted_ids = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    trusted_ids = materialize(trusted_ids, "trusted-ids")
    nats = materialize(perplexities(docs, trusted_ids, id_col, text_col, lang_col), "nats")
    good = nats.where("unseen AND chars > 0").join(trusted_ids, "doc_id", "left_semi")
    excess = F.round(F.col("nats") - F.lit(SHORT) / F.sqrt("chars"), 3)  # a bounded number of values, so that the quantile is exact
    cut = F.percentile(excess, quantile).alias("cut")
    overall = good.agg(cut).first()["cut"]
    cuts = materialize(good.groupBy(F.col("lang").alias("_lang")).agg(cut), "cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= LANGUAGES else cuts  # one row a language; few languages hold most rows
    known = nats.join(cuts, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.coalesce("cut", F.lit(math.inf if overall is None else overall)) + margin + F.lit(SHORT) / F.sqrt(F.greatest("chars", F.lit(1)))
    return known.withColumn("threshold", threshold).select("doc_id", "lang", F.exp("nats").alias("perplexity"), "threshold", ((F.col("chars") == 0) | (F.col("nats") <= F.col("threshold"))).alias("keep"))


@own_names
def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rejected documents."""
    held = numbered(docs, "quality-rows")
    own = held.select(ROW, F.col(id_col).cast("long").alias("doc_id")).join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), "doc_id").select(F.col(ROW).alias("doc_id"), "quality")
    bad = judge(held, own, ROW, text_col, lang_col).where(~F.col("keep")).select(F.col("doc_id").alias(ROW))
    return without(held, materialize(bad, "rejected")).select(docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
