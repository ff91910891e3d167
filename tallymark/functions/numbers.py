"""Column expressions over numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded as SQL engines in C do: the double times a power of ten to the nearest whole number. Spark's own goes by the shortest decimal, which may be a tie where the product is none."""
    power = F.lit(10.0**digits)
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * power) / power


def percent_text(c: Column) -> Column:
    """Two decimals and a percent sign, from the double's exact value; the JVM's format goes by its shortest decimal. For tables of one row a cell."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if pd.isna(x) else f"{x:.2f}%")

    return run(c.cast("double"))
