"""Queries on reports, the store's indexes and metadata, and which functions take part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, report, scan
from ..sources import facts, store
from . import fixtures as fx
from .match_queries import _CAND, _FUZZY, _PROBES, _SURE, _scored, _versions
from .registry import query
from .store_queries import _FILLED, _rows

_DISPLAY = r"regexp_replace(regexp_replace({c}, '^.*/', ''), '^[^.]*\.', '')"


@query(f"""WITH {_PROBES}, {fx.SIGNATURES_SQL}, {_scored(_CAND, '0.5')} SELECT id AS signature_id, name AS signature_name, severity, {_DISPLAY.format(c='function_name')} AS matched_function, round(confidence, 6)::DOUBLE AS confidence
 FROM scored WHERE {_SURE} 0.3 AND NOT coalesce(regexp_matches(function_name, '[()\\[\\]]'), false)""")
def alert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the indexed scan as report rows; no function of the table has brackets in its name."""
    found = scan.scan_bucket(scan.probes(fx.functions(spark, d)), fx.signatures(spark, d), 0.3)
    return report.alert_rows(found).select("signature_id", "signature_name", "severity", "matched_function", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {fx.FUNCTIONS_SQL} SELECT (SELECT count(*) FROM functions) + (SELECT count(*) FROM orders) AS total_functions_scanned, (SELECT count(*) FROM orders) AS dependencies_scanned, 0.75::DOUBLE AS threshold,
 count(*) AS total_alerts, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM scan_results""")
def scan_report(spark: SparkSession, d: str) -> DataFrame:
    return report.scan_summary(fx.read(spark, d, "scan_results"), fx.functions(spark, d), fx.read(spark, d, "orders"))


@query("""SELECT l_orderkey % 97 AS file, array_to_string(list_sort(list(l_linenumber || ':' || l_partkey) FILTER (l_returnflag <> 'R')), ',') AS functions, min(CASE WHEN l_returnflag = 'R' THEN 'bad ' || l_linestatus END) AS error FROM lineitem GROUP BY 1""")
def file_report(spark: SparkSession, d: str) -> DataFrame:
    """Line items stand for functions of 97 files; returned ones have an error."""
    li = fx.read(spark, d, "lineitem")
    bad = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("bad "), "l_linestatus"))
    rows = li.select((F.col("l_orderkey") % 97).alias("file"), F.concat("l_linenumber", F.lit(":"), "l_partkey").alias("function_name"), F.lit("").alias("fingerprint"), bad.alias("error"))
    return report.file_rows(rows).select("file", F.array_join("functions.function", ",").alias("functions"), "error")


@query(f"""WITH {_FILLED} SELECT 'hash' AS "index", topology_hash AS key, id FROM base_ WHERE coalesce(topology_hash, '') <> '' UNION ALL SELECT 'bucket', fuzzy_hash, id FROM base_ WHERE coalesce(fuzzy_hash, '') <> ''
 UNION ALL SELECT 'entropy', printf('%08.4f', entropy_score) || ':' || id, id FROM base_ WHERE entropy_score IS NOT NULL""")
def index_entries(spark: SparkSession, d: str) -> DataFrame:
    return store.index_entries(_rows(spark, d, "signatures"))


@query("""WITH e AS (SELECT c_nationkey AS store, ['version', 'created_at', 'owner', 'note', 'description'][(c_custkey % 5 + 1)::INT] AS key, c_name AS value, c_custkey AS position FROM customer),
 l AS (SELECT store, key, arg_max(value, position) AS value FROM e GROUP BY ALL)
 SELECT store, max(value) FILTER (key = 'version') AS version, max(value) FILTER (key = 'description') AS description, max(value) FILTER (key = 'created_at') AS created_at,
 coalesce(array_to_string(list_sort(list(key || '=' || value) FILTER (key IN ('owner', 'note'))), ';'), '') AS custom FROM l GROUP BY store""")
def metadata_pivot(spark: SparkSession, d: str) -> DataFrame:
    c = fx.read(spark, d, "customer")
    key = F.element_at(F.array(*[F.lit(x) for x in ("version", "created_at", "owner", "note", "description")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    out = store.pivot_metadata(c.select(F.col("c_nationkey").alias("store"), key.alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("position")))
    custom = F.array_join(F.transform(F.map_entries("custom"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("store", "version", "description", "created_at", custom.alias("custom"))


@query("""WITH RECURSIVE f AS (SELECT o_orderkey AS func_id, CASE WHEN o_orderkey % 8 = 1 THEN 'p.init' ELSE 'p.F' || o_orderkey END AS name, o_orderkey % 4 = 1 AS made, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 END AS parent, o_custkey % 5 AS file FROM orders),
 gone(func_id) AS (SELECT func_id FROM f WHERE made AND name <> 'p.init' UNION SELECT f.func_id FROM f JOIN gone ON f.parent = gone.func_id)
 SELECT func_id, name AS function_name FROM f WHERE func_id NOT IN (SELECT func_id FROM gone) AND func_id IN (SELECT l_orderkey FROM lineitem) AND file <> 0""")
def visible_functions(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic, nested and bodiless functions and those of one file left out."""
    k = F.col("o_orderkey")
    f = fx.read(spark, d, "orders").select(
        k.alias("func_id"), F.when(k % 8 == 1, "p.init").otherwise(F.concat(F.lit("p.F"), k)).alias("function_name"), (k % 4 == 1).alias("is_synthetic"),
        F.when(k % 3 == 0, F.expr("o_orderkey div 2")).alias("parent_func_id"), (F.col("o_custkey") % 5).cast("string").alias("file"),
    )
    empty = spark.createDataFrame([], "func_id long")
    body = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("func_id"))
    held = facts.Facts(facts.conform(f, "functions"), facts.conform(body, "instrs"), facts.conform(empty, "operands"), facts.conform(empty, "edges"))
    return facts.visible(held, F.col("file") != "0").functions.select("func_id", "function_name")


_SHAPE = "'L' || coalesce({p}loop_count, 0) || 'B' || coalesce({p}branch_count, 0) || 'I' || coalesce({p}instr_count, 0)"


@query(f"""WITH {_FUZZY} SELECT o.function_name AS old_name, {_SHAPE.format(p='o.')} AS old_shape, {_SHAPE.format(p='n.')} AS new_shape FROM o JOIN n USING (key)""")
def diff_matches(spark: SparkSession, d: str) -> DataFrame:
    """Topology labels of the pairs by name, up to the list of calls."""
    pairs = diff.match_by_name(*_versions(spark, d)).withColumn("old_name", F.col("old_function_name"))
    cut = lambda c: F.regexp_extract(c, r"^[^\[]*", 0)
    return diff.matches(pairs, "old_name").select("old_name", cut("old_topology").alias("old_shape"), cut("new_topology").alias("new_shape"))
