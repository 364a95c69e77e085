"""A session for work on one machine; on a cluster the caller brings its own."""

from __future__ import annotations

import warnings

from pyspark.sql import SparkSession


def session(threads: int | None = None, memory_limit: str | None = None, warehouse: str | None = None, shared: str | None = None) -> SparkSession:
    """The running session, else a local one.

    ``threads`` sets cores and shuffle partitions, ``memory_limit`` the driver's
    memory (such as '4g'), ``warehouse`` where tables outlive the session, and
    ``shared`` the folder for lineage cuts. A running session keeps its own
    settings; a warning names those that were asked for.
    """
    if (running := SparkSession.getActiveSession()) is not None:
        asked = [k for k, v in (("threads", threads), ("memory_limit", memory_limit), ("warehouse", warehouse), ("shared", shared)) if v is not None]
        if asked:
            warnings.warn(f"a session runs already; not set: {', '.join(asked)}", stacklevel=3)
        return running
    b = SparkSession.builder.master(f"local[{threads or '*'}]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in (("spark.sql.shuffle.partitions", threads), ("spark.driver.memory", memory_limit), ("spark.sql.warehouse.dir", warehouse), ("spark.checkpoint.dir", shared)):
        if value is not None:
            b = b.config(key, str(value))
    return b.getOrCreate()
