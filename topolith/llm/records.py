"""The record views the operators of this subpackage work on.

Rules that hold for every view: a list value is compared after removing white
space at both ends; null and empty values do not exist; a value counts once per
record; a null list is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space removed at the ends of a value, and the shape of a call.
BLANKS = " \t\n\r\f\x0b\xa0"
IDENT = r"[\p{L}_][\p{L}\p{N}_]*"
CALL = rf"^(?:{IDENT}\s*=\s*)?(?:(?:go|defer)\s+)?({IDENT}(?:\.{IDENT})+)\("


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def value_set(c: Column) -> Column:
    """Distinct non-empty trimmed values, sorted by code point; null becomes empty."""
    kept = F.filter(F.transform(c, trimmed), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def call_names(ops: Column) -> Column:
    """Sorted distinct call names of a list of ops (see TESTDATA.md, Queries)."""
    name = lambda op: F.when(~op.rlike(r"\binvoke\b"), F.regexp_extract(op, CALL, 1))
    return value_set(F.transform(F.transform(ops, trimmed), name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def added_op_records(diffs: DataFrame) -> DataFrame:
    """(record_key, items): one row per ``diff_id``; a null id makes each row its own record.

    A record delivered again has the same content, so any of its rows will do; the
    smallest list is taken to make the choice fixed.  Lists are cut down to call
    names before the shuffle.
    """
    d = diffs.select(F.col("diff_id").alias("record_key"), call_names(F.col("added_ops")).alias("items"))
    one = d.where("record_key is not null").groupBy("record_key").agg(F.min("items").alias("items"))
    return one.unionByName(d.where("record_key is null"))


def required_call_records(signatures: DataFrame) -> DataFrame:
    """(record_key, items): one row per signature row."""
    return signatures.select(
        F.col("row_id").alias("record_key"),
        value_set(F.col("identifying_features.required_calls")).alias("items"),
    )


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, record_key, items) of both fields."""
    ops = added_op_records(read(spark, sf_dir, "function_diffs")).select(F.lit("added_ops").alias("field"), "*")
    req = required_call_records(read(spark, sf_dir, "signatures")).select(F.lit("required_calls").alias("field"), "*")
    return ops.unionByName(req)


def feature_set() -> Column:
    """All values of the three feature lists of a signature row as one set."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(f"identifying_features.{n}"), empty) for n in ("required_calls", "optional_calls", "string_patterns")]
    return value_set(F.concat(*lists))


def feature_rows(table: DataFrame) -> DataFrame:
    """(row_id, tokens) of a table with signature columns."""
    return table.select("row_id", feature_set().alias("tokens"))
