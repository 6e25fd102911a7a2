"""Normal forms of qualified names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def composed(name: str | None) -> str | None:
    """Trimmed (any white space, no-break space included) and composed (NFC); None stays None."""
    if name is None:
        return None
    name = name.strip()
    return name if name.isascii() else unicodedata.normalize("NFC", name)


@F.pandas_udf(T.StringType())
def _composed_column(names: pd.Series) -> pd.Series:
    return pd.Series([composed(x) for x in names], dtype=object)


def composed_name(column: Column) -> Column:
    """``composed`` over a column; Spark has no built-in for Unicode composition."""
    return _composed_column(column)
