"""Time as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a whole number that keeps its order; no time zone comes in where it has none.

    Strings are read as timestamps without zone; those that aren't give null.
    """
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', try_cast(`{name}` as timestamp_ntz))")
    if kind in ("timestamp_ntz", "date"):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(`{name}` as timestamp_ntz))")
    return F.unix_micros(name) if kind == "timestamp" else F.col(name).cast("long")


def from_micros(us: Column) -> Column:
    """The timestamp without zone that so many microseconds after 1970 are."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
