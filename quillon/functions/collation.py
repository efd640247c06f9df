"""Sort keys of the named collations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc_lower(c: Column) -> Column:
    """NFKC, then lower case; Spark has no built-in normalisation, so an Arrow UDF gives the key."""
    import pandas as pd

    def key(s):
        return s.str.normalize("NFKC").str.lower()

    key.__annotations__ = {"s": pd.Series, "return": pd.Series}  # the kind of UDF is read from real types
    return F.pandas_udf(key, "string")(c)


def collated(c: Column, name: str | None) -> Column:
    if name is None:
        return c
    if name == "unicode-lowercase":
        return F.lower(c)
    if name == "unicode-nfkc-lowercase":
        return nfkc_lower(c)
    return F.collate(c, name.rpartition("-")[2])
