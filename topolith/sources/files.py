"""Source files: listing, filters, bounds, change lists.

Parsing and compiling source code is outside this engine; the fact tables are its input.  Listing and
filtering files, their sizes and the change list of a commit are data operations and are here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE = 10 * 1024 * 1024


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to ``root``, length) of the Go files below a folder, without their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.go").load(root).select("path", "length")
    base = root.rstrip("/").removeprefix("file:") + "/"
    return found.select(F.substring_index("path", base, -1).alias("path"), "length")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content, error): files over the size bound carry an error in place of content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.go").load(root)
    base = root.rstrip("/").removeprefix("file:") + "/"
    error = size_error(F.col("length"))
    return found.select(F.substring_index("path", base, -1).alias("path"), "length", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def is_source(path: Column) -> Column:
    """Go files that are no tests and not below ``vendor`` or a hidden folder; paths are relative to the root."""
    name = F.substring_index(path, "/", -1)
    test = name.endswith("_test.go") & (F.length(name) >= 8)
    return path.endswith(".go") & ~test & ~path.rlike(r"(^|/)(vendor|\.[^/]+)/")


def is_ci_source(path: Column) -> Column:
    """Files a change check looks at: no tests, no generated files, nothing below the top ``vendor``."""
    return path.endswith(".go") & ~path.endswith("_test.go") & ~path.endswith("_generated.go") & ~path.startswith("vendor/")


def size_error(length: Column) -> Column:
    return F.when(length > MAX_FILE, F.concat(F.lit("file too large: "), length, F.lit(" bytes")))


def total_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))


def name_status(stream: Column) -> Column:
    """array<struct<status, old_path, new_path>> of a NUL-delimited change list.

    Renames and copies have two paths, additions no old one; deletions are left out.
    """
    fields = F.filter(F.split(stream, "\\x00"), lambda x: x != "")
    entry = "struct<status:string,old_path:string,new_path:string>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        now = F.array_append(acc["open"], x)
        status = now[0]
        two = status.substr(1, 1).isin("R", "C")
        full = F.size(now) == F.when(two, 3).otherwise(2)
        row = F.struct(status.alias("status"), F.when(status == "A", "").otherwise(F.get(now, F.lit(1))).alias("old_path"), F.when(two, F.get(now, F.lit(2))).otherwise(F.get(now, F.lit(1))).alias("new_path"))
        kept = F.when(full & (status != "D"), F.array_append(acc["done"], row)).otherwise(acc["done"])
        return F.struct(kept.alias("done"), F.when(full, F.array().cast("array<string>")).otherwise(now).alias("open"))

    return F.aggregate(fields, start, step)["done"]
