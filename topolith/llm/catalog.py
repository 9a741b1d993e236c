"""Queries pN_ over the tables of a directory, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cooccur, distinctive, history, leakage, packing, records, setjoin, topn, truncation
from .records import read

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.tied_pairs(records.call_records(spark, d)).select("field", "item_a", "item_b")


def p1_association(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.cooccurrence(records.call_records(spark, d), min_count=5)
    return pairs.select("field", "item_a", "item_b", "n", "count_a", "count_b", "count_ab", F.round("pmi", 6).alias("pmi"), F.round("lift", 6).alias("lift"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(read(spark, d, "signatures"), read(spark, d, "signature_feed"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    named = read(spark, d, "scan_results").where("matched_function <> ''")
    return topn.top_n(named, "matched_function", "signature_id", "confidence", 5).select("matched_function", "signature_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive.distinctiveness(records.call_records(spark, d))
    return distinctive.best_terms(scored, 12).select("field", "record_key", "term")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive.distinctiveness(records.call_records(spark, d))
    return scored.select("field", "record_key", "term", "df", F.col("n_terms").cast("long").alias("n_terms"), F.round("score", 6).alias("score"))


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    return records.feature_rows(read(spark, d, "signatures")).unionByName(records.feature_rows(read(spark, d, "signature_feed")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_rows(feature_table(spark, d))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Every row that takes part, with its class, named by its least row, and the number of its links."""
    rows = setjoin.similar_counts(feature_table(spark, d))
    least = rows.groupBy("class_id").agg(F.min("row_id").alias("class_row"))
    return rows.join(least, "class_id").select("row_id", "class_row", "links")


def containers(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The kinds of containers, a configuration table of at most 100 rows."""
    rows = read(spark, d, "container_sizes").select("container_kind", "capacity_tokens").distinct().limit(101).collect()
    if len(rows) > 100:
        raise ValueError("container_sizes holds more than 100 kinds")
    return sorted((r[0], r[1]) for r in rows)


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    sized = packing.materialize_counts(read(spark, d, "documents"))
    return packing.pack(sized, containers(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_assignment(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(read(spark, d, "documents")).select("doc_id")


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return truncation.truncation_by_source(docs, truncation.truncated(docs))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_association, p2_found, p3_found, p4_found, p4_scores, p5_found, p5_links, p6_assignment, p6_fill, p7_found, p8_found, p8_share)
}
