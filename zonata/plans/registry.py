"""All registered queries of the library and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, files, geometry, lobules, masks, profile, raster, records, regions, slides, spatial, statistics

_MODULES = (profile, statistics, geometry, raster, catalog, masks, spatial, records, files, regions, lobules, slides)


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
