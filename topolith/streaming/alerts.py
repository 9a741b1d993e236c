"""Scanning and indexing as streams: new feature rows against the signature table.

Nothing here is keyed by time, so no watermark and no state is needed: a scan is a stream-static join and
an index is an upsert per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import scan
from ..sources.store import Store


def feature_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Stream of feature rows from the parquet files that appear under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def alerts(features: DataFrame, signatures: DataFrame, threshold: float = scan.DEFAULT_THRESHOLD, tolerance: float = scan.DEFAULT_TOLERANCE, *extra: str) -> DataFrame:
    """Alerts of a batch or stream of feature rows; the signatures are read anew for every micro-batch."""
    return scan.scan_bucket(scan.probes(features), signatures, threshold, tolerance, *extra)


def write_alerts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append alerts as parquet, exactly once per input file, until the input seen now is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_into(features: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Upsert the signatures of streamed functions, one store version per micro-batch.

    Repeating a batch after a failure writes the same rows again, which an upsert absorbs.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = scan.index_functions(batch).withColumn("position", F.lit(number).cast("long"))
        if not rows.isEmpty():
            store.add(rows)

    return features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
