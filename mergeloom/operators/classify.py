"""What a column means: by the edit distance of its name to aliases, or by the likeness of a sample to exemplars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import Embedder, embed_distinct
from ..functions.similarity import cosine, rescale
from ..functions.standardize import REGISTRY
from .pairs import first_best

DISTANCE_LIMIT = 10
SAMPLE_ROWS = 2
ACCEPT = 0.0


def nearest_alias(headers: DataFrame, aliases: DataFrame, limit: int = DISTANCE_LIMIT) -> DataFrame:
    """(header, category, dist): each header's nearest alias below limit, the first in file order on ties, else 'etc'.

    Both sides are names, not data: as many rows as columns and aliases.
    """
    pairs = headers.join(F.broadcast(aliases), how="cross").withColumn("dist", F.levenshtein(F.lower("header"), F.lower("alias")))
    best = first_best(pairs.withColumn("near", -F.col("dist")), ["header"], "near", ["ordinal", "pos", "category", "dist"])
    near = F.col("dist") < limit
    return best.select("header", F.when(near, F.col("category")).otherwise("etc").alias("category"), F.when(near, F.col("dist")).alias("dist"))


def categories_of(df: DataFrame, aliases: DataFrame, limit: int = DISTANCE_LIMIT) -> dict[str, str]:
    """column -> category, in column order."""
    headers = df.sparkSession.createDataFrame([(c,) for c in df.columns], "header string")
    found = {r["header"]: r["category"] for r in nearest_alias(headers, aliases, limit).collect()}
    return {c: found[c] for c in df.columns}


def categorize(df: DataFrame, aliases: DataFrame, limit: int = DISTANCE_LIMIT) -> DataFrame:
    """df with categories for names. Of columns with one category the last is kept, in the first one's place."""
    chosen: dict[str, str] = {}
    for column, category in categories_of(df, aliases, limit).items():
        chosen[category] = column
    return df.select(*(F.col(f"`{column}`").alias(category) for category, column in chosen.items()))


def sample_texts(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(position, column, text): header and first cells of each column, letters, digits, colons and slashes only, lower case."""
    head = df.limit(rows)
    clean = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9:/]", "")
    cells = head.agg(*(F.collect_list(F.when(F.col(f"`{c}`") != "NULL", clean(F.col(f"`{c}`").cast("string")))).alias(f"_{i}") for i, c in enumerate(df.columns)))
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lower(F.concat_ws(" ", clean(F.lit(c)), F.col(f"_{i}"))).alias("text")) for i, c in enumerate(df.columns)]
    return cells.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def classify(df: DataFrame, embedder: Embedder, accept: float = ACCEPT) -> DataFrame:
    """(position, column, category, score): the exemplar most like each column's sample, 'etc' below accept; first exemplar on ties."""
    spark: SparkSession = df.sparkSession
    rows = [(i, c, e.split(",")[0]) for i, (c, (e, _)) in enumerate(REGISTRY.items())]
    exemplars = spark.createDataFrame(rows, "ordinal int, category string, exemplar string")
    exemplars = embed_distinct(exemplars, "exemplar", "e", embedder)
    texts = embed_distinct(sample_texts(df), "text", "v", embedder)
    scored = texts.join(F.broadcast(exemplars), how="cross").withColumn("score", F.coalesce(rescale(cosine(F.col("v"), F.col("e")), embedder.baseline), F.lit(-1.0)))
    best = first_best(scored, ["position", "column"], "score", ["ordinal", "category", "score"])
    return best.select("position", "column", F.when(F.col("score") >= accept, F.col("category")).otherwise("etc").alias("category"), "score")
