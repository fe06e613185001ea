"""The stateless standardisers on a streaming DataFrame.

A temperature column is planned from a batch first, as its unit is a property of the
whole column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.standardize import TemperaturePlan, clean_table, standardizer, temperature


def standardize_stream(stream: DataFrame, categories: Mapping[str, str], temperatures: Mapping[str, TemperaturePlan] | None = None) -> DataFrame:
    """stream, cleaned, each column by its category's standardiser; works on batches alike."""
    plans = temperatures or {}
    df = clean_table(stream)
    out = []
    for c in df.columns:
        cell = F.col(f"`{c}`")
        if c in plans:
            cell = temperature(cell, plans[c])
        elif c in categories:
            cell = standardizer(categories[c])(cell)
        out.append(cell.alias(c))
    return df.select(*out)
