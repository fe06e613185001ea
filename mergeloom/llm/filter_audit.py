"""Filter interaction audit: how filters overlap, from one CUBE over their failure flags.

Every row gets five failure flags. Rows are counted by flags, part and label first, which
leaves 128 rows a part at most, and a CUBE over the flags and the part is taken of these
counts. Its grouping-set rows whose selected flags are all false count the survivors
of that subset of filters. A step of an order takes the survivors of the filters
before it and of those with it; so all orders are joins of pairs of subsets.

Copies are told by the SHA-256 of their texts: the smallest doc_id by digest is a partial
aggregation, and joining it back is a plain join of small rows, which Spark may split
where a text is very frequent.

Cases: a null text is an empty one (no word, so it fails A; 0 < 0 does not hold, so it
passes B and C); a null lang is the part '', as an empty one is; rows without doc_id have no smaller copy and are no
smaller copy of others; rows that repeat a doc_id count each, and have no smaller copy in each other; labels that repeat a doc_id count as 1
if one says so, null labels as 0; texts of any length are judged whole; further columns are ignored,
and no name of theirs can clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize, whole_text

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50
MAX_CAPITALS = 3
SYMBOLS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
MEASURES = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The failure flags that a text alone decides; n_words and n_distinct are columns of the same rows."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.col("n_words") < MIN_WORDS,
        "B": 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"),
        "C": 100 * capitals > MAX_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic): a row for every row of docs; texts are read once and never shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), whole_text().alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    rows = rows.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))})
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(f.alias(k) for k, f in text_flags(F.col("text")).items()))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "digest").join(said, "doc_id", "left")
    return rows.select("part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def survivors(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, subset, n, good, toxic) for every part and every subset of filters, as a bit mask: rows that fail none of it; zeros included."""
    counts = rows.groupBy("part", *filters).agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("good", "toxic")))
    counts = materialize(counts, "flag-counts")  # few rows, which all that follows is made of
    cube = counts.cube("part", *filters).agg(*(F.sum(m).alias(m) for m in MEASURES), F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"out_{f}") for f in filters))
    passed = F.lit(True)
    subset = F.lit(0)
    for i, f in enumerate(filters):
        passed = passed & ((F.col(f"out_{f}") == 1) | ~F.col(f))
        subset = subset + (1 - F.col(f"out_{f}").cast("int")) * (1 << i)
    found = cube.where((F.col("all_parts") == 0) & passed).select("part", subset.alias("subset"), *MEASURES)
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").na.fill(0, list(MEASURES))


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, filter, before, after): every step of every order, with the subsets of filters before and after it."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    rows = []
    for order in permutations(filters):
        before = 0
        for k, f in enumerate(order):
            rows.append(("".join(order), k + 1, bit[f], before, before | bit[f]))
            before |= bit[f]
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int, after int")


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for every part, order of the filters and step; counts of the part's documents."""
    spark = rows.sparkSession
    alive = survivors(rows, filters)
    full = (1 << len(filters)) - 1
    named = lambda tag: alive.select("part", F.col("subset").alias(tag), *(F.col(m).alias(f"{tag}_{m}") for m in MEASURES))
    before, after = named("before"), named("after")
    plan = F.broadcast(steps(spark, filters))  # its size is that of the filters' orders
    walked = plan.join(before, "before").join(after, ["part", "after"])
    # of each filter: all that fail it, that fail it alone, and what it removes over all orders
    single = plan.select("bit").distinct().select("bit", F.explode(F.sequence(F.lit(0), F.lit(full))).alias("before")).where(F.col("before").bitwiseAND(F.col("bit")) == 0)
    single = single.withColumn("after", F.col("before") + F.col("bit")).join(before, "before").join(after, ["part", "after"])
    size = F.bit_count("before")
    weight = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(len(filters) - 1 - k)) for k in range(len(filters)))), size.cast("int") + 1)
    gone = F.col("before_n") - F.col("after_n")
    own = single.groupBy("part", "bit").agg(
        F.sum(gone * weight).cast("long").alias("shapley"), F.sum(F.when(size == 0, gone)).alias("fails"), F.sum(F.when(size == len(filters) - 1, gone)).alias("unique_fails")
    )
    out = walked.join(own, ["part", "bit"])
    return out.select(
        "part", "filter_order", "step", F.col("after_n").alias("kept"), gone.alias("removed"), (F.col("fails") - gone).alias("redundant"), "unique_fails",
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"), "shapley",
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


SQL = r"""
WITH said AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(words) < 200)::INT AS A, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS B,
    (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT AS C,
    regexp_matches(text, '[#$%&*|]')::INT AS D,
    coalesce(min(d.doc_id) OVER (PARTITION BY text) < d.doc_id, false)::INT AS E
  FROM d LEFT JOIN said ON said.doc_id = d.doc_id),
g AS (SELECT part, {'A': A, 'B': B, 'C': C, 'D': D, 'E': E} AS fail, A + B + C + D + E AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS path FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT array_to_string(path, '') AS filter_order, unnest(range(1, 6))::INT AS step, path FROM o),
w AS (
  SELECT part, filter_order, step, path[step] AS own, n, good, toxic, fails,
    list_any_value([CASE WHEN struct_extract(fail, 'A') = 1 AND x = 'A' OR struct_extract(fail, 'B') = 1 AND x = 'B' OR struct_extract(fail, 'C') = 1 AND x = 'C'
      OR struct_extract(fail, 'D') = 1 AND x = 'D' OR struct_extract(fail, 'E') = 1 AND x = 'E' THEN i END FOR x, i IN path]) AS first,
    CASE path[step] WHEN 'A' THEN fail.A WHEN 'B' THEN fail.B WHEN 'C' THEN fail.C WHEN 'D' THEN fail.D ELSE fail.E END AS hit
  FROM g, s),
r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE first IS NULL OR first > step), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE first = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE hit = 1 AND first < step), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE hit = 1 AND fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE first = step), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE first = step), 0)::BIGINT AS toxic_lost
  FROM w GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r"""
