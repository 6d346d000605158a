"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import angle_queries, cell_queries, cell_sql

HELPERS = {"points", "pixels", "embedded", "grid", "anchors", "supplier_sites", "cells_2g3g", "lookup_cells", "neighbour_pairs", "table"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for module in (angle_queries, cell_queries):
        for name, f in inspect.getmembers(module, inspect.isfunction):
            if f.__module__ == module.__name__ and not name.startswith("_") and name not in HELPERS:
                out[name] = f
    return out


def oracle_sql() -> dict[str, str]:
    return angle_queries.SQL | cell_sql.SQL
