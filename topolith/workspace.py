"""Intermediate tables that outlive executors, and small files that are replaced in one step.

Lineage is cut by writing parquet into the folder that ``spark.checkpoint.dir``
names, which every executor shares, so a lost executor costs a re-read and not
a recomputation.  Only a session without that setting (unit tests, notebooks)
gets a local folder of its own.  Either is deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_KNOWN: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base:
        path = f"{base.rstrip('/')}/topolith-{app}"
        if path not in _KNOWN:
            _KNOWN.add(path)
            at, fs = _located(spark, path)
            fs.mkdirs(at)
            fs.deleteOnExit(at)
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="topolith-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back: no lineage, known size for the optimizer."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _located(spark, path)
    fs.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none if there is no such folder."""
    at, fs = _located(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def clean(spark: SparkSession) -> None:
    """Delete every intermediate table of this application."""
    remove(spark, scratch_dir(spark))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: a reader sees the old content or the new, never neither."""
    jvm = spark.sparkContext._jvm
    next_at, fs = _located(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(next_at, True)
    out.write(bytearray(text.encode()))
    out.close()
    at = jvm.org.apache.hadoop.fs.Path(path)
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(next_at), fs.makeQualified(at), how)


def get_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file, null if there is none."""
    at, fs = _located(spark, path)
    if not fs.exists(at):
        return None
    source = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
