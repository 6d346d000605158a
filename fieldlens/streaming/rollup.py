"""Verdicts over a stream of analyses, by workbook and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.operators import reports


def windowed_verdicts(analyses: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, workbook, analyses, failures, crosses, checks, verdict) of a stream or table (workbook, kind, verdict, time).

    Rows later than late are left out; a window is final when the watermark passes its end.
    """
    agg = analyses.withWatermark(time, late).groupBy(F.window(time, window), "workbook").agg(*reports.rollup_counts())
    return agg.withColumn("verdict", reports.rollup_text(F.col("failed_checks"), F.col("crosses"), F.col("checks"))).drop("failed_checks")
