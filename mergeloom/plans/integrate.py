"""Whole pipelines: ``stack_tables`` by column categories, ``integrate`` by schema and entity matching."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embed import Embedder, HashingNgramEmbedder
from ..functions.formats import Format, plan_formats, restore_table, standard_table
from ..functions.standardize import FIELDS, clean_table, field_standardizer, plan_temperature, standardizer, temperature
from ..operators.assign import assign
from ..operators.classify import categorize, classify
from ..operators.match import ENTITY_THRESHOLD, match_schemas, score_pairs
from ..operators.merge import match_audit, merge_tables, stack
from ..operators.profile import profile
from ..storage import materialize

ROW = "_row"


@dataclass(frozen=True)
class Config:
    embedder: Embedder = field(default_factory=HashingNgramEmbedder)
    schema_threshold: float = 0.3
    entity_threshold: float = ENTITY_THRESHOLD
    schema_map: dict[str, str] | None = None
    exact_categories: bool = False
    kinds: dict[str, str] | None = None
    clean: bool = True
    standardize: bool = True
    mode: str = "exact"
    rounds: int = 1
    restore: bool = False


@dataclass(frozen=True)
class Result:
    merged: DataFrame
    matches: DataFrame
    schema_map: dict[str, str | None]
    entity_map: DataFrame
    profile: DataFrame


def stack_tables(master: DataFrame, dependent: DataFrame, aliases: DataFrame) -> DataFrame:
    """Both tables under the categories of their columns, the master's names reduced to first names."""
    a, b = categorize(master, aliases), categorize(dependent, aliases)
    known = {c: field_standardizer(c) for c in a.columns if c.replace(" ", "_") in FIELDS}
    return stack(a.withColumns({c: fn(F.col(f"`{c}`")) for c, fn in known.items()}), b)


def content_categories(df: DataFrame, embedder: Embedder, skip: tuple[str, ...] = (ROW,)) -> dict[str, str]:
    return {r["column"]: r["category"] for r in classify(df.drop(*skip), embedder).collect()}  # one row a column


def standardize_reversibly(df: DataFrame, embedder: Embedder) -> tuple[DataFrame, dict[str, Format]]:
    """(df in standard form, the formats that restore_table needs): categories that have formats by these, the others by their standardisers."""
    found = content_categories(df, embedder)
    known = plan_formats(df, found, ROW if ROW in df.columns else None)
    other = {c: standardizer(k)(F.col(f"`{c}`")) for c, k in found.items() if c not in known}
    return standard_table(df.withColumns(other) if other else df, known), known


def standardize_table(df: DataFrame, embedder: Embedder, skip: tuple[str, ...] = (ROW,)) -> DataFrame:
    """Every column by the standardiser of the category its sample is most like."""
    found = content_categories(df, embedder, skip)
    out = {}
    for c, category in found.items():
        cell = F.col(f"`{c}`")
        out[c] = temperature(cell, plan_temperature(df, c, ROW if ROW in df.columns else None)) if category == "temperature" else standardizer(category)(cell)
    return df.withColumns(out)


def with_rows(df: DataFrame, id_col: str | None) -> DataFrame:
    return df.withColumn(ROW, F.col(id_col).cast("long")) if id_col else materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _text(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))


def integrate(left: DataFrame, right: DataFrame, config: Config = Config(), left_id: str | None = None, right_id: str | None = None) -> Result:
    """Clean, standardise, match columns and rows, merge.

    left_id, right_id: unique integer columns that order the rows; without them rows
    are numbered. rounds: repeat schema and entity matching, keeping of the schema map
    what the matched rows agree on, until the map stays or the rounds are used up. Config.restore: show
    the merged table in the formats of the left one (see functions.formats).
    """
    a, b = (_text(x) if config.clean else x for x in (left, right))
    if config.clean:
        a, b = clean_table(a), clean_table(b)
    a, b = with_rows(a, left_id), with_rows(b, right_id)
    formats: dict[str, Format] = {}
    if config.standardize and config.restore:
        (a, formats), (b, _) = (standardize_reversibly(x, config.embedder) for x in (a, b))
    elif config.standardize:
        a, b = standardize_table(a, config.embedder), standardize_table(b, config.embedder)
    names = [[c for c in x.columns if c != ROW] for x in (a, b)]
    schema = config.schema_map or match_schemas(*names, config.embedder, config.schema_threshold)
    schema = {c: schema.get(c) for c in names[0]}
    entity = None
    for _ in range(max(1, config.rounds)):
        pairs = score_pairs(a, b, schema, ROW, ROW, config.entity_threshold, config.embedder, config.exact_categories, config.kinds, again=config.mode == "exact")
        entity = materialize(assign(pairs, config.entity_threshold, config.mode), "entities")
        agreed = agreeing(a, b, entity, schema)
        if agreed == schema or not any(agreed.values()):
            break
        schema = agreed
    return Result(restore_table(merge_tables(a, b, schema, entity, ROW, ROW), formats), _audit(a, b, entity), schema, entity, profile(a.drop(ROW)))


def _audit(a: DataFrame, b: DataFrame, entity: DataFrame) -> DataFrame:
    out = match_audit(a, b, entity, ROW, ROW)
    return out.drop(ROW, f"{ROW}_right")


def agreeing(a: DataFrame, b: DataFrame, entity: DataFrame, schema: dict[str, str | None], least: float = 0.05) -> dict[str, str | None]:
    """The schema map without the pairs that hardly any matched rows agree on; one aggregate."""
    mapped = [(x, y) for x, y in schema.items() if y is not None]
    joined = entity.join(a.select(F.col(ROW).alias("left_id"), *(F.col(f"`{x}`").alias(f"l{i}") for i, (x, _) in enumerate(mapped))), "left_id")
    joined = joined.join(b.select(F.col(ROW).alias("right_id"), *(F.col(f"`{y}`").alias(f"r{i}") for i, (_, y) in enumerate(mapped))), "right_id")
    row = joined.agg(*(F.avg(1 - F.levenshtein(F.col(f"l{i}").cast("string"), F.col(f"r{i}").cast("string")) / F.greatest(F.length(f"l{i}"), F.length(f"r{i}"), F.lit(1))).alias(f"s{i}") for i in range(len(mapped)))).first()
    kept = {x: y if row[f"s{i}"] is None or row[f"s{i}"] >= least else None for i, (x, y) in enumerate(mapped)}
    return {x: kept.get(x) for x in schema}
