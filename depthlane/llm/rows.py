"""How documents reach Python: keys as text, so that nulls and long integers arrive whole."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def key(value) -> int | None:
    return int(value) if isinstance(value, str) else None


def keys(column) -> pd.Series:
    return pd.Series([key(k) for k in column], dtype="Int64")
