"""Queries on the signature store operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from . import fixtures as fx
from .registry import query

_ID = "CASE WHEN coalesce(id, '') <> '' THEN id ELSE 'SFW-AUTO-' || substr(sha256(concat_ws(chr(31), row_id::VARCHAR, coalesce(name, ''), coalesce(topology_hash, ''), coalesce(fuzzy_hash, ''))), 1, 16) END"
_FILLED = f"""base_ AS (SELECT row_id, {_ID} AS id, name, topology_hash, fuzzy_hash, entropy_score FROM signatures),
 feed_ AS (SELECT row_id, {_ID} AS id, name, topology_hash, fuzzy_hash, entropy_score FROM signature_feed)"""


def _rows(spark: SparkSession, d: str, table: str) -> DataFrame:
    return store.with_ids(fx.read(spark, d, table).select("row_id", "id", "name", "topology_hash", "fuzzy_hash", "entropy_score"), "row_id")


@query(f"""WITH {_FILLED}, new_ AS (SELECT * FROM feed_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1)
 SELECT * FROM base_ WHERE id NOT IN (SELECT id FROM new_) UNION ALL SELECT * FROM new_""")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(_rows(spark, d, "signatures"), _rows(spark, d, "signature_feed"), "row_id")


@query(f"WITH {_FILLED} SELECT id, count(*) AS rows, arg_max(name, row_id) FILTER (row_id = last) AS name FROM (SELECT *, max(row_id) OVER (PARTITION BY id) AS last FROM (SELECT * FROM base_ UNION ALL SELECT * FROM feed_)) GROUP BY id")
def append_duplicates(spark: SparkSession, d: str) -> DataFrame:
    both = store.append(_rows(spark, d, "signatures"), _rows(spark, d, "signature_feed"))
    last = store.last_of_batch(both, "row_id").select("id", "name")
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).join(last, "id").select("id", "rows", "name")


@query(f"WITH {_FILLED} SELECT * FROM base_ WHERE id NOT IN (SELECT id FROM feed_)")
def delete_sig(spark: SparkSession, d: str) -> DataFrame:
    return store.delete(_rows(spark, d, "signatures"), _rows(spark, d, "signature_feed").select("id").distinct())


@query("""WITH m AS (SELECT id, min(name) AS notes FROM signature_feed WHERE coalesce(id, '') <> '' GROUP BY id)
 SELECT row_id, array_to_string(list_concat(coalesce(metadata.references, []), CASE WHEN m.id IS NULL THEN [] ELSE ['FP:2025-06-01T00:00:00Z:' || coalesce(notes, '')] END), '|') AS refs, metadata.author AS author FROM signatures LEFT JOIN m USING (id)""")
def mark_fp(spark: SparkSession, d: str) -> DataFrame:
    marks = fx.read(spark, d, "signature_feed").where("coalesce(id, '') <> ''").groupBy("id").agg(F.min("name").alias("notes"))
    rows = fx.read(spark, d, "signatures").select("row_id", "id", "metadata")
    out = store.mark_false_positive(rows, marks, F.lit("2025-06-01").cast("timestamp"))
    return out.select("row_id", F.array_join(F.coalesce("metadata.references", F.array().cast("array<string>")), "|").alias("refs"), F.col("metadata.author").alias("author"))


@query(f"SELECT row_id, {_ID} AS id FROM signatures")
def auto_ids(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d, "signatures").select("row_id", "id")


@query("SELECT topology_hash, min(id) AS id FROM signatures WHERE topology_hash <> '' AND id IS NOT NULL GROUP BY topology_hash")
def sig_by_topology(spark: SparkSession, d: str) -> DataFrame:
    return store.first_by_hash(fx.read(spark, d, "signatures"))


@query("SELECT row_id, id, entropy_score FROM signatures WHERE entropy_score BETWEEN 4.5 AND 5.5")
def entropy_range(spark: SparkSession, d: str) -> DataFrame:
    return store.entropy_range(fx.read(spark, d, "signatures"), 4.5, 5.5).select("row_id", "id", "entropy_score")


@query(f"WITH {_FILLED} SELECT DISTINCT id FROM base_")
def sig_ids(spark: SparkSession, d: str) -> DataFrame:
    return store.ids(_rows(spark, d, "signatures"))


@query("SELECT count(*) AS signatures, count(*) FILTER (coalesce(topology_hash, '') <> '') AS by_hash, count(*) FILTER (coalesce(fuzzy_hash, '') <> '') AS by_bucket, count(*) FILTER (entropy_score IS NOT NULL) AS by_entropy FROM signatures")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.statistics(fx.read(spark, d, "signatures"))


@query(f"""WITH {_FILLED} SELECT row_id, id, '{{"row_id":' || row_id || ',"id":"' || id || '"' || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END || '}}' AS line FROM base_""")
def export_json(spark: SparkSession, d: str) -> DataFrame:
    lines = store.export_json(_rows(spark, d, "signatures").select("row_id", "id", "name"))
    return lines.select(F.get_json_object("line", "$.row_id").cast("long").alias("row_id"), "id", "line")
