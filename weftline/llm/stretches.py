"""Cutting a text into stretches that many texts share, such as the sentences and lines of a page's revisions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Before the white space at the end of a line or of a sentence.
_CUT = re.compile(r"(?<=\S)(?=[\r\n])|(?<=[.!?])(?= )")
#: The same where an exclamation mark ends nothing, since it may stand for a letter.
_CUT_NOT_AFTER_EXCLAMATION = re.compile(r"(?<=\S)(?=\r?\n)|(?<=[.?])(?= )")


def stretches(text: str | None, after_exclamation: bool = True) -> list[str]:
    """Parts that together are the text; every part but the first begins with white space, and none ends with it but the last.

    Without ``after_exclamation`` cuts are only at line feeds and after '.' and '?'.
    """
    cut = _CUT if after_exclamation else _CUT_NOT_AFTER_EXCLAMATION
    return cut.split(text) if text else []


def spread(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` as they are where their files already make as many tasks as run at once; fewer and larger ones are cut in ranges of ``by``.

    Ranges keep neighbours, such as the revisions of a page, in one task, where their shared stretches are read once.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartitionByRange(tasks, by)
