"""Loading the canonical relation: (set_id string, node_id string [, sort_column])."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from pathlib import PurePath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY = "set_id string, node_id string"


def read_source(spark: SparkSession, source: Any) -> DataFrame:
    """A Spark frame as it is; a path by its suffix (.csv, .parquet, or a folder of Parquet); else a pandas, polars or Arrow frame."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, (str, PurePath)):
        path = str(source)
        suffix = PurePath(path).suffix.lower()
        if suffix == ".csv":
            return spark.read.csv(path, header=True, inferSchema=True)
        if suffix in (".parquet", ""):
            return spark.read.parquet(path)
        raise ValueError(f"Unsupported file type: {suffix}")
    if hasattr(source, "collect") and hasattr(source, "lazy"):
        source = source.collect() if type(source).__name__ == "LazyFrame" else source
    if hasattr(source, "to_arrow"):
        source = source.to_arrow()
    if not hasattr(source, "columns") and not hasattr(source, "schema"):
        raise TypeError(f"no table: {type(source).__name__}")
    return spark.createDataFrame(source)


def canonical(df: DataFrame, set_col: str, node_col: str, sort_col: str | None = None, sort_callback: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Renamed and cast columns, without rows that lack set or node. Null sort values stay; other columns go.

    ``sort_callback`` may rework the renamed frame; if it fails, a warning is
    given and the frame is used as it was.
    """
    wanted = [set_col, node_col] + ([sort_col] if sort_col else [])
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    out = df.select(F.col(f"`{set_col}`").cast("string").alias("set_id"), F.col(f"`{node_col}`").cast("string").alias("node_id"), *([F.col(f"`{sort_col}`").alias("sort_column")] if sort_col else []))
    return reworked(out, sort_callback).dropna(subset=["set_id", "node_id"])


def reworked(df: DataFrame, callback: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """``df`` after the callback; as it was, with a warning, where that fails."""
    try:
        return df.transform(callback) if callback else df
    except Exception as e:
        warnings.warn(f"sort_callback failed: {e}", stacklevel=3)
        return df


def append(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Rows of both; a sort column that one lacks is null there."""
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def from_matrix(df: DataFrame, set_col: str = "set_id") -> DataFrame:
    """A wide frame (one row a set, one column a node) as interactions: values above 0 count."""
    if set_col not in df.columns:
        raise ValueError(f"Missing columns: ['{set_col}']")
    nodes = [c for c in df.columns if c != set_col]
    long = df.select(set_col, *[F.col(f"`{c}`").cast("double").alias(c) for c in nodes]).unpivot(set_col, nodes, "node_id", "value")
    return canonical(long.where(F.col("value") > 0), set_col, "node_id")


def write(df: DataFrame, path: str) -> None:
    """Stores interactions as Parquet."""
    df.write.mode("overwrite").parquet(path)
