"""Report rows: alerts in their order, the scan summary, and fingerprints by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from . import scan


def alert_rows(alerts: DataFrame, short: bool = True) -> DataFrame:
    """Scored pairs of a scan as alerts, under short or full function names, by function, then signature name.

    ``alerts`` as the scans give them.  Ties are put in the order of the signature id.
    """
    name = names.display_name(F.col("function_name")) if short else F.col("function_name")
    details = ("topology_match", "entropy_match", "calls_matched", "calls_missing", "strings_matched", "topology_similarity", "entropy_distance")
    rows = alerts.select(
        F.col("s_id").alias("signature_id"), F.col("s_name").alias("signature_name"), F.col("s_severity").alias("severity"), name.alias("matched_function"), "confidence",
        F.struct(*details).alias("match_details"),
    )
    return in_order(rows)


def in_order(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("matched_function", "signature_name", "signature_id")


def by_confidence(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.col("confidence").desc_nulls_last(), "signature_id")


def scan_summary(alerts: DataFrame, functions: DataFrame, dependency_functions: DataFrame | None = None, threshold: float = scan.DEFAULT_THRESHOLD) -> DataFrame:
    """One row: functions scanned, those of dependencies, alerts in all and by severity.

    ``alerts`` of files and dependencies together (``severity``).  The dependency figure counts functions, not packages.
    """
    n = F.count(F.lit(1))
    deps = functions.limit(0) if dependency_functions is None else dependency_functions
    totals = functions.agg(n.alias("own")).crossJoin(deps.agg(n.alias("dependencies_scanned")))  # one row each
    rows = scan.severity_rollup(alerts).withColumnRenamed("total", "total_alerts").crossJoin(totals)
    return rows.select((F.col("own") + F.col("dependencies_scanned")).alias("total_functions_scanned"), "dependencies_scanned", F.lit(threshold).alias("threshold"), "total_alerts", "critical", "high", "medium", "low")


def file_rows(prints: DataFrame) -> DataFrame:
    """One row per file: its functions with fingerprints by name, and the first error, errors being data.

    ``prints(file, function_name, fingerprint, error)``; a file's functions are few, so the list is bounded by the file.
    """
    entry = F.when(F.col("error").isNull(), F.struct(F.col("function_name").alias("function"), "fingerprint"))
    return prints.groupBy("file").agg(F.array_sort(F.collect_list(entry)).alias("functions"), F.min("error").alias("error"))
