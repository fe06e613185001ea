"""Merging two tables: the left-preferred merge by a match table, its audit, and the stack by category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_columns(left: list[str], right: list[str], schema_map: dict[str, str | None]) -> list[tuple[str, str | None, str | None]]:
    """(output name, left column, right column for unmatched right rows): left attributes, then right ones that are no match target."""
    targets = {b for b in schema_map.values() if b is not None}
    out = []
    for c in left:
        own = c if c in right and c not in targets else schema_map.get(c)
        if c in right and schema_map.get(c) not in (None, c):
            own = c  # a column of the same name wins over a mapped one
        out.append((c, c, own))
    names = [*left, *(c for c in right if c not in targets)]
    for c, name in list(zip(names, free_names(names), strict=True))[len(left) :]:
        out.append((name, None, c))
    return out


def free_names(names: list[str]) -> list[str]:
    """names, but each that stood before, in any case, with the suffix _right, or _right2, _right3, ... until it is free."""
    given, taken, out = {c.lower() for c in names}, set(), []
    for c in names:
        name, n = c, 1
        while name.lower() in taken or (name != c and name.lower() in given):
            name, n = f"{c}_right{n if n > 1 else ''}", n + 1
        taken.add(name.lower())
        out.append(name)
    return out


def unmatched(right: DataFrame, matches: DataFrame, right_id: str) -> DataFrame:
    """The rows of right that are in no match (left_id, right_id)."""
    return right.join(matches.select(F.col("right_id").alias("_m")), F.col(f"`{right_id}`").cast("long") == F.col("_m"), "left_anti")


def merge_tables(left: DataFrame, right: DataFrame, schema_map: dict[str, str | None], matches: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Matched and unmatched left rows, then unmatched right rows. A left value stays even where it is null."""
    left_cols, right_cols = [c for c in left.columns if c != left_id], [c for c in right.columns if c != right_id]
    columns = merged_columns(left_cols, right_cols, schema_map)
    pairs = matches.select(F.col("left_id").alias("_l"), F.col("right_id").alias("_r"))
    a = left.select(F.col(f"`{left_id}`").cast("long").alias("_l"), *(F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(left_cols)))
    b = right.select(F.col(f"`{right_id}`").cast("long").alias("_r"), *(F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(right_cols)))
    cell = lambda prefix, names, c: F.col(f"{prefix}{names.index(c)}").cast("string")
    joined = a.join(pairs, "_l", "left").join(b, "_r", "left")
    first = joined.select(*((cell("a", left_cols, x) if x else cell("b", right_cols, y)).alias(n) for n, x, y in columns))
    rest = unmatched(b, matches, "_r")
    second = rest.select(*((cell("b", right_cols, y) if y else F.lit(None).cast("string")).alias(n) for n, _, y in columns))
    return first.unionByName(second)


def match_audit(left: DataFrame, right: DataFrame, matches: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """left.* beside right.*, full outer over the matches; a name that both have gets the suffix _right on the right, see free_names."""
    pairs = matches.select(F.col("left_id").alias("_l"), F.col("right_id").alias("_r"))
    a = left.select(F.col(f"`{left_id}`").cast("long").alias("_l"), *(F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(left.columns)))
    b = right.select(F.col(f"`{right_id}`").cast("long").alias("_r"), *(F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(right.columns)))
    held = [*(f"a{i}" for i in range(len(left.columns))), *(f"b{i}" for i in range(len(right.columns)))]
    names = free_names([*left.columns, *right.columns])
    return a.join(pairs, "_l", "left").join(b, "_r", "full_outer").select(*(F.col(c).alias(n) for c, n in zip(held, names, strict=True)))


def stack(master: DataFrame, dependent: DataFrame) -> DataFrame:
    """Rows of master, then of dependent, by column name; missing cells are null."""
    text = lambda df: df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
    return text(master).unionByName(text(dependent), allowMissingColumns=True)
