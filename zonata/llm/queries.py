"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, audio, language, mixing, neardup, periods, quality, repeats, secrets, sentencepieces, suffixtree, tokenfiles, warc

_MODULES = (mixing, quality, tokenfiles, secrets, audio, repeats, sentencepieces, suffixtree, neardup, language, periods, alignment, warc)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= module.SQL
    return found
