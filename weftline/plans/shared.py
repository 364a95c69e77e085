"""Cutting lineage in a folder that all executors share.

Nothing here keeps data on one executor: what is cut is written as Parquet
below the folder that the session names in ``spark.checkpoint.dir``, so a lost
executor costs a re-read and no recomputation.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Read from the context, else from ``spark.checkpoint.dir``. Only a local
    master, as in tests, gets a temporary folder; on a cluster a missing
    setting is an error, as a machine-local folder would be lost with it.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="weftline-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


_scopes: list[list[Cut]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Drops, at its end, every table cut inside it; results that read them must be stored or collected by then."""
    held: list[Cut] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.remove(held)
        for c in held:
            c.drop()


class Cut:
    """A table written to the shared folder; ``drop()`` removes its files, as does the end of a :func:`scope` around it."""

    def __init__(self, df: DataFrame, name: str = "cut"):
        spark = df.sparkSession
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        self._spark = spark
        if _scopes:
            _scopes[-1].append(self)

    def drop(self) -> None:
        jvm = self._spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Cut(df, name).df


def least_count(total: int, share: float) -> int:
    """The least whole number that is at least ``share`` of ``total``, with ``share`` taken as written in decimals."""
    return math.ceil(Fraction(str(share)) * total)
