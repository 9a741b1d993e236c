"""Queries on similarity, scans, diffs, dependencies, loops, files and the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, scoring, text
from ..operators import closure, diff, scan
from ..sources import files
from . import fixtures as fx
from .feature_queries import _list, _map, bucket_sql, hash_sql, join_name_sql
from .registry import query

# ---------------------------------------------------------------- SQL pieces


def ruzicka_sql(a: str, b: str) -> str:
    keys = f"list_distinct(list_concat(map_keys({_map(a)}), map_keys({_map(b)})))"
    part = lambda f: f"coalesce(list_sum(list_transform({keys}, lambda k: {f}(coalesce({_map(a)}[k], 0), coalesce({_map(b)}[k], 0)))), 0)"
    return f"CASE WHEN {part('greatest')} = 0 THEN 1.0::DOUBLE ELSE {part('least')}::DOUBLE / {part('greatest')} END"


def dice_sql(a: str, b: str) -> str:
    a, b = _list(a), _list(b)
    same = f"len(list_filter(list_zip({a}, {b}), lambda z: z[1] = z[2]))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {same} / (len({a}) + len({b})) END"


def similarity_sql(a: str, b: str) -> str:
    n = lambda p, c: f"coalesce({p}{c}, 0)"
    gap = lambda c: f"abs({n(a, c)} - {n(b, c)})"
    most = lambda c: f"greatest({n(a, c)}, {n(b, c)})"
    flag = lambda c: f"CASE WHEN coalesce({a}{c}, false) = coalesce({b}{c}, false) THEN 0.2::DOUBLE ELSE 0 END"
    parts = [
        f"3.0::DOUBLE * ({dice_sql(a + 'param_types', b + 'param_types')})", f"2.0::DOUBLE * ({dice_sql(a + 'return_types', b + 'return_types')})",
        f"2.0::DOUBLE * (CASE {gap('loop_count')} WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END)::DOUBLE",
        f"1.5::DOUBLE * (CASE WHEN {most('branch_count')} > 0 THEN 1 - {gap('branch_count')}::DOUBLE / {most('branch_count')} ELSE 1.0 END)",
        f"4.0::DOUBLE * ({ruzicka_sql(a + 'call_signatures', b + 'call_signatures')})", f"1.0::DOUBLE * ({ruzicka_sql(a + 'binop_counts', b + 'binop_counts')})",
        f"0.5::DOUBLE * ({ruzicka_sql(a + 'instr_counts', b + 'instr_counts')})",
        "(" + " + ".join(flag(c) for c in ("has_defer", "has_panic", "has_go", "has_select", "has_range")) + ")",
        f"0.5::DOUBLE * (CASE WHEN {most('block_count')} > 0 THEN 1 - {gap('block_count')}::DOUBLE / (2 * {most('block_count')}) ELSE 1.0 END)",
    ]
    return "(" + " + ".join(parts) + ") / 15.5"


# ---------------------------------------------------------------- similarity of functions in a bucket

# Probes: the functions whose id 50 divides, against every function of their bucket.
_SEARCH = f"""{fx.FUNCTIONS_SQL}, b AS (SELECT *, {bucket_sql()} AS bucket FROM functions),
 pairs AS (SELECT x AS a, y AS b FROM b x JOIN b y ON x.bucket = y.bucket AND x.func_id % 50 = 0 AND x.func_id <> y.func_id)"""


def _search(spark: SparkSession, d: str, columns: tuple[str, ...] = diff.FEATURES) -> DataFrame:
    f = scoring.side()
    bucket = names.fuzzy_hash(f["block_count"], f["loop_count"], f["branch_count"], f["param_count"], f["return_count"])
    rows = fx.functions(spark, d).select(bucket.alias("bucket"), F.struct("func_id", *columns).alias("a"))
    pairs = rows.where("a.func_id % 50 = 0").join(rows.withColumnRenamed("a", "b"), "bucket")
    return pairs.where("a.func_id <> b.func_id").select("a", "b")


@query(f"WITH {_SEARCH} SELECT a.func_id AS a, b.func_id AS b, round({similarity_sql('a.', 'b.')}, 6)::DOUBLE AS similarity FROM pairs")
def topology_similarity(spark: SparkSession, d: str) -> DataFrame:
    sim = scoring.topology_similarity(scoring.side("a"), scoring.side("b"))
    return _search(spark, d).select(F.col("a.func_id").alias("a"), F.col("b.func_id").alias("b"), F.round(sim, 6).alias("similarity"))


@query(f"WITH {_SEARCH} SELECT a.func_id AS a, b.func_id AS b, round({ruzicka_sql('a.call_signatures', 'b.call_signatures')}, 6)::DOUBLE AS calls FROM pairs")
def map_similarity(spark: SparkSession, d: str) -> DataFrame:
    none = F.create_map().cast("map<string,int>")
    sim = scoring.map_similarity(F.coalesce("a.call_signatures", none), F.coalesce("b.call_signatures", none))
    return _search(spark, d, ("call_signatures",)).select(F.col("a.func_id").alias("a"), F.col("b.func_id").alias("b"), F.round(sim, 6).alias("calls"))


@query(f"WITH {_SEARCH} SELECT a.func_id AS a, b.func_id AS b, round({dice_sql('a.param_types', 'b.param_types')}, 6)::DOUBLE AS params FROM pairs")
def type_dice(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    sim = scoring.type_dice(F.coalesce("a.param_types", none), F.coalesce("b.param_types", none))
    return _search(spark, d, ("param_types",)).select(F.col("a.func_id").alias("a"), F.col("b.func_id").alias("b"), F.round(sim, 6).alias("params"))


# ---------------------------------------------------------------- similarity of all pairs of a bucket

_PAIRS = f"""{fx.FUNCTIONS_SQL}, b AS (SELECT *, {bucket_sql()} AS bucket FROM functions),
 pairs AS (SELECT x AS a, y AS b FROM b x JOIN b y ON x.bucket = y.bucket AND x.func_id < y.func_id)"""


def bucket_pairs(functions: DataFrame, columns: tuple[str, ...] = diff.FEATURES, blocks: int = 16) -> DataFrame:
    """(a, b): structs of ``func_id`` and ``columns`` for every two functions of a bucket, the smaller id first.

    One side is spread over ``blocks`` and the other repeated for each, so a full bucket is no single task.
    """
    f = scoring.side()
    bucket = names.fuzzy_hash(f["block_count"], f["loop_count"], f["branch_count"], f["param_count"], f["return_count"])
    rows = functions.select(bucket.alias("bucket"), F.struct("func_id", *columns).alias("a"))
    left = rows.withColumn("block", F.pmod(F.xxhash64("a.func_id"), F.lit(blocks)).cast("int"))
    right = rows.withColumnRenamed("a", "b").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.join(right, ["bucket", "block"]).where("a.func_id < b.func_id").select("a", "b")


@query(f"WITH {_PAIRS} SELECT a.func_id AS a, b.func_id AS b, round({similarity_sql('a.', 'b.')}, 6)::DOUBLE AS similarity FROM pairs")
def topology_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    sim = scoring.topology_similarity(scoring.side("a"), scoring.side("b"))
    return bucket_pairs(fx.functions(spark, d)).select(F.col("a.func_id").alias("a"), F.col("b.func_id").alias("b"), F.round(sim, 6).alias("similarity"))


@query(f"WITH {_PAIRS} SELECT a.func_id AS a, b.func_id AS b, round({ruzicka_sql('a.call_signatures', 'b.call_signatures')}, 6)::DOUBLE AS calls FROM pairs")
def map_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    none = F.create_map().cast("map<string,int>")
    sim = scoring.map_similarity(F.coalesce("a.call_signatures", none), F.coalesce("b.call_signatures", none))
    pairs = bucket_pairs(fx.functions(spark, d), ("call_signatures",))
    return pairs.select(F.col("a.func_id").alias("a"), F.col("b.func_id").alias("b"), F.round(sim, 6).alias("calls"))


@query(f"WITH {_PAIRS} SELECT a.func_id AS a, b.func_id AS b, round({dice_sql('a.param_types', 'b.param_types')}, 6)::DOUBLE AS params FROM pairs")
def type_dice_pairs(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    sim = scoring.type_dice(F.coalesce("a.param_types", none), F.coalesce("b.param_types", none))
    pairs = bucket_pairs(fx.functions(spark, d), ("param_types",))
    return pairs.select(F.col("a.func_id").alias("a"), F.col("b.func_id").alias("b"), F.round(sim, 6).alias("params"))


# ---------------------------------------------------------------- scans

_PROBES = f"""{fx.FUNCTIONS_SQL}, probes AS (SELECT func_id, function_name, substr(sha256({hash_sql()}), 1, 32) AS hash, {bucket_sql()} AS bucket, coalesce(entropy_score, 0) AS entropy,
  coalesce(block_count, 0) AS blocks, coalesce(loop_count, 0) AS loops, map_keys({_map('call_signatures')}) AS calls, list_filter({_list('string_literals')}, lambda x: x IS NOT NULL) AS literals,
  obfuscation.score AS obf_score, obfuscation.class AS obf_class, obfuscation.indirect_call_ratio AS indirect FROM functions)"""

_TRIM = "trim(x, chr(34) || chr(39) || '`')"
_INDEX = f"""idx AS (SELECT func_id, 'SFW-IDX-' || lpad(func_id::VARCHAR, 12, '0') AS id, function_name AS name, 'HIGH' AS severity, substr(sha256({hash_sql()}), 1, 32) AS topology_hash, {bucket_sql()} AS fuzzy_hash,
  coalesce(entropy_score, 0) AS entropy_score, 0.5::DOUBLE AS entropy_tolerance, coalesce(block_count, 0) AS node_count, coalesce(loop_count, 0) AS loop_depth, list_sort(map_keys({_map('call_signatures')})) AS required_calls,
  list_sort(list_distinct(list_filter(list_transform(list_filter({_list('string_literals')}, lambda x: x IS NOT NULL AND strlen(x) >= 3), lambda x: {_TRIM}), lambda x: strlen(x) >= 3))) AS string_patterns,
  coalesce(loop_count, 0) > 0 AND NOT coalesce(has_range, false) AS has_infinite_loop,
  len(list_filter(map_keys({_map('call_signatures')}), lambda c: contains(c, 'net.Dial'))) > 0 AND len(list_filter(map_keys({_map('call_signatures')}), lambda c: contains(c, 'time.Sleep'))) > 0 AND coalesce(loop_count, 0) > 0 AS has_reconnect_logic,
  obfuscation.score AS obfuscation_score FROM functions)"""


def _scored(pairs: str, tol: str) -> str:
    band = f"CASE WHEN coalesce(s.entropy_tolerance, 0) = 0 THEN {tol}::DOUBLE ELSE s.entropy_tolerance END"
    return f"""ev AS (SELECT p.*, s.*, {band} AS band, abs(p.entropy - s.entropy_score) AS dist, coalesce(p.hash = s.topology_hash, false) AS same,
   list_filter(s.required_calls, lambda r: len(list_filter(p.calls, lambda c: contains(c, r))) > 0) AS found,
   list_filter(s.string_patterns, lambda r: len(list_filter(p.literals, lambda l: contains(lower(l), lower(r)))) > 0) AS hits,
   CASE WHEN s.node_count > 0 THEN CASE WHEN p.blocks <= 0 THEN 0.0::DOUBLE WHEN p.blocks > s.node_count THEN s.node_count / p.blocks::DOUBLE ELSE p.blocks::DOUBLE / s.node_count END END AS bs,
   CASE WHEN s.loop_depth > 0 THEN CASE WHEN p.loops <= 0 THEN 0.0::DOUBLE WHEN p.loops > s.loop_depth THEN s.loop_depth / p.loops::DOUBLE ELSE p.loops::DOUBLE / s.loop_depth END END AS ls
   FROM {pairs}),
  ev2 AS (SELECT *, coalesce(list_avg(list_filter([bs, ls], lambda x: x IS NOT NULL)), 0.5) AS likeness FROM ev),
  ev3 AS (SELECT *, list_avg(list_filter([CASE WHEN same THEN 1.0::DOUBLE ELSE likeness END, CASE WHEN dist <= band THEN CASE WHEN band = 0 THEN 'nan'::DOUBLE ELSE 1 - dist / band END ELSE 0.5::DOUBLE END,
     CASE WHEN len(required_calls) > 0 THEN len(found)::DOUBLE / len(required_calls) END, CASE WHEN len(string_patterns) > 0 AND len(hits) > 0 THEN len(hits)::DOUBLE / len(string_patterns) END], lambda x: x IS NOT NULL)) AS avg_ FROM ev2),
  scored AS (SELECT *, CASE WHEN len(found) < len(required_calls) AND coalesce(indirect, 0) < 0.5 AND coalesce(obf_class, 'NONE') IN ('NONE', 'LOW') THEN 0.0::DOUBLE
     WHEN avg_ >= 0.4 AND NOT isnan(avg_) THEN greatest(avg_, 0.5 * coalesce(obf_score, 0)) ELSE avg_ END AS confidence FROM ev3)"""


_BAND = "abs(p.entropy - s.entropy_score) <= CASE WHEN coalesce(s.entropy_tolerance, 0) = 0 THEN 0.5 ELSE s.entropy_tolerance END"
_CAND = f"probes p JOIN sigs s ON (p.hash = s.topology_hash OR (s.fuzzy_hash <> '' AND p.bucket = s.fuzzy_hash)) AND {_BAND}"
_SURE = "NOT isnan(confidence) AND confidence >= "


def _evidence(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_PROBES}, {fx.SIGNATURES_SQL}, {_scored(_CAND, '0.5')} SELECT func_id, row_id, severity, round(confidence, 6)::DOUBLE AS confidence, round(dist, 6)::DOUBLE AS entropy_distance, array_to_string(found, ',') AS calls_matched, array_to_string(hits, ',') AS strings_matched, same OR likeness > 0.8 AS topology_match FROM scored WHERE {_SURE} 0.3")
def scan_bucket(spark: SparkSession, d: str) -> DataFrame:
    out = scan.scan_bucket(scan.probes(fx.functions(spark, d)), fx.signatures(spark, d), 0.3, 0.5, "row_id")
    return out.select(
        "func_id", F.col("s_row_id").alias("row_id"), F.col("s_severity").alias("severity"), F.round("confidence", 6).alias("confidence"), F.round("entropy_distance", 6).alias("entropy_distance"),
        F.array_join("calls_matched", ",").alias("calls_matched"), F.array_join("strings_matched", ",").alias("strings_matched"), "topology_match",
    )


@query(f"WITH {_PROBES}, {fx.SIGNATURES_SQL} SELECT func_id, row_id FROM {_CAND}")
def scan_candidates(spark: SparkSession, d: str) -> DataFrame:
    return scan.candidates(scan.probes(fx.functions(spark, d)), fx.signatures(spark, d), 0.5, "row_id").select("func_id", F.col("s_row_id").alias("row_id"))


@query(f"WITH {_PROBES}, {_INDEX}, s1 AS (SELECT * EXCLUDE (func_id) FROM idx), {_scored('probes p JOIN s1 s ON p.hash = s.topology_hash AND ' + _BAND, '0.5')} SELECT func_id, id AS signature_id, round(confidence, 6)::DOUBLE AS confidence FROM scored WHERE {_SURE} 0.75 QUALIFY row_number() OVER (PARTITION BY func_id ORDER BY confidence DESC, id) = 1")
def scan_exact_top1(spark: SparkSession, d: str) -> DataFrame:
    f = fx.functions(spark, d)
    return _evidence(scan.scan_exact(scan.probes(f), scan.index_functions(f)), "func_id", F.col("s_id").alias("signature_id"))  # type: ignore[arg-type]


# Probes of a full scan: the functions whose id 50 divides, against all signatures.
_QUERY_SET = "(SELECT * FROM probes WHERE func_id % 50 = 0) p CROSS JOIN sigs s"


@query(f"WITH {_PROBES}, {fx.SIGNATURES_SQL}, {_scored(_QUERY_SET, '0.5')} SELECT func_id, row_id, round(confidence, 6)::DOUBLE AS confidence FROM scored WHERE {_SURE} 0.75")
def scan_full_cross(spark: SparkSession, d: str) -> DataFrame:
    p = scan.probes(fx.functions(spark, d)).where("func_id % 50 = 0")
    out = scan.confidences(p, fx.signatures(spark, d), 0.75, scan.DEFAULT_TOLERANCE, ("func_id",), ("row_id",))
    return _evidence(out, F.col("k_func_id").alias("func_id"), F.col("a_row_id").alias("row_id"))  # type: ignore[arg-type]


@query(f"""WITH {_PROBES}, {_INDEX}, s1 AS (SELECT * EXCLUDE (func_id), func_id AS pos FROM idx), {_scored('(SELECT * FROM probes WHERE func_id % 50 = 0) p CROSS JOIN s1 s', '0.0')}
 SELECT func_id, id AS signature_id FROM scored WHERE {_SURE} 0.99 QUALIFY row_number() OVER (PARTITION BY func_id ORDER BY pos) = 1""")
def scan_json_exact(spark: SparkSession, d: str) -> DataFrame:
    f = fx.functions(spark, d)
    p = scan.probes(f).where("func_id % 50 = 0")
    sigs = scan.index_functions(f).withColumn("pos", F.substring("id", 9, 12).cast("long"))
    return scan.scan_full_exact(p, sigs, "pos").select("func_id", F.col("s_id").alias("signature_id"))


@query(f"WITH {fx.FUNCTIONS_SQL}, {_INDEX} SELECT id, name, topology_hash, fuzzy_hash, node_count, loop_depth, array_to_string(required_calls, ',') AS required_calls, array_to_string(string_patterns, ',') AS string_patterns, has_infinite_loop, has_reconnect_logic FROM idx")
def index_functions(spark: SparkSession, d: str) -> DataFrame:
    i = scan.index_functions(fx.functions(spark, d))
    return i.select(
        "id", "name", "topology_hash", "fuzzy_hash", "node_count", "loop_depth", F.array_join("required_calls", ",").alias("required_calls"), F.array_join("string_patterns", ",").alias("string_patterns"), "has_infinite_loop", "has_reconnect_logic"
    )


@query(f"""WITH {fx.FUNCTIONS_SQL}, {fx.SIGNATURES_SQL}, p AS (SELECT func_id, map_keys({_map('call_signatures')}) AS calls, {bucket_sql()} AS bucket, list_filter({_list('string_literals')}, lambda x: x IS NOT NULL) AS lits FROM functions)
 SELECT func_id, row_id, array_to_string(list_filter(required_calls, lambda r: len(list_filter(calls, lambda c: contains(c, r))) > 0), ',') AS matched, array_to_string(list_filter(required_calls, lambda r: len(list_filter(calls, lambda c: contains(c, r))) = 0), ',') AS missing,
  array_to_string(list_filter(string_patterns, lambda r: len(list_filter(lits, lambda c: contains(lower(c), lower(r)))) > 0), ',') AS strings FROM p JOIN sigs ON bucket = fuzzy_hash""")
def calls_matched_missing(spark: SparkSession, d: str) -> DataFrame:
    p, s = scan.probes(fx.functions(spark, d)), fx.signatures(spark, d).select("row_id", "fuzzy_hash", "required_calls", "string_patterns")
    j = p.join(s, F.col("bucket") == F.col("fuzzy_hash"))
    text_of = lambda c: F.array_join(c, ",")
    return j.select(
        "func_id", "row_id", text_of(scoring.calls_found(F.col("required_calls"), F.col("calls"))).alias("matched"), text_of(scoring.calls_missing(F.col("required_calls"), F.col("calls"))).alias("missing"),
        text_of(scoring.patterns_found(F.col("string_patterns"), F.col("literals"))).alias("strings"),
    )


@query("""SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low
 FROM (SELECT severity FROM scan_results UNION ALL SELECT severity FROM signatures)""")
def scan_rollup(spark: SparkSession, d: str) -> DataFrame:
    alerts = fx.read(spark, d, "scan_results").select("severity").unionByName(fx.read(spark, d, "signatures").select("severity"))
    return scan.severity_rollup(alerts)


# ---------------------------------------------------------------- diffs

# A second version of every function: some renamed, some changed, some gone.
_VERSIONS = f"""{fx.FUNCTIONS_SQL}, old_ AS (SELECT function_name || '_' || func_id AS function_name, param_count, return_count, block_count, instr_count, loop_count, branch_count, has_defer, has_panic, has_go, has_select, has_range, call_signatures, binop_counts, instr_counts, param_types, return_types, entropy_score, func_id FROM functions),
 new_ AS (SELECT * REPLACE (CASE WHEN func_id % 10 = 0 THEN function_name || 'V2' ELSE function_name END AS function_name, CASE WHEN func_id % 7 = 0 THEN coalesce(loop_count, 0) + 1 ELSE loop_count END AS loop_count,
   CASE WHEN func_id % 11 = 0 THEN true ELSE has_go END AS has_go, entropy_score + CASE WHEN func_id % 17 = 0 THEN 1.7 ELSE 0 END AS entropy_score) FROM old_ WHERE func_id % 13 <> 0),
 o AS (SELECT *, {join_name_sql('function_name')} AS key, {bucket_sql()} AS bucket, sha256({hash_sql()}) AS fp FROM old_ WHERE function_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {join_name_sql('function_name')} ORDER BY function_name DESC, sha256({hash_sql()}) DESC) = 1),
 n AS (SELECT *, {join_name_sql('function_name')} AS key, {bucket_sql()} AS bucket, sha256({hash_sql()}) AS fp FROM new_ WHERE function_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {join_name_sql('function_name')} ORDER BY function_name DESC, sha256({hash_sql()}) DESC) = 1)"""


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    named = F.concat("function_name", F.lit("_"), "func_id").alias("function_name")
    old = fx.functions(spark, d).select("func_id", named, *diff.FEATURES)
    k = F.col("func_id")
    new = old.where(k % 13 != 0).withColumns({
        "function_name": F.when(k % 10 == 0, F.concat("function_name", F.lit("V2"))).otherwise(F.col("function_name")),
        "loop_count": F.when(k % 7 == 0, F.coalesce("loop_count", F.lit(0)) + 1).otherwise(F.col("loop_count")),
        "has_go": F.when(k % 11 == 0, True).otherwise(F.col("has_go")),
        "entropy_score": F.col("entropy_score") + F.when(k % 17 == 0, 1.7).otherwise(0.0),
    })
    return diff.version(old), diff.version(new)


@query(f"WITH {_VERSIONS} SELECT o.function_name AS old_name, n.function_name AS new_name, round({similarity_sql('o.', 'n.')}, 6)::DOUBLE AS similarity, o.fp = n.fp AS same FROM o JOIN n USING (key)")
def diff_name_match(spark: SparkSession, d: str) -> DataFrame:
    m = diff.match_by_name(*_versions(spark, d))
    return m.select(F.col("old_function_name").alias("old_name"), F.col("new_function_name").alias("new_name"), F.round("similarity", 6).alias("similarity"), (F.col("old_fingerprint") == F.col("new_fingerprint")).alias("same"))


@query(f"WITH {_VERSIONS} SELECT 'removed' AS side, function_name FROM o WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT 'added', function_name FROM n WHERE key NOT IN (SELECT key FROM o)")
def diff_added_removed(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    gone = diff.unmatched(old, new).select(F.lit("removed").alias("side"), "function_name")
    return gone.unionByName(diff.unmatched(new, old).select(F.lit("added").alias("side"), "function_name"))


_FUZZY = f"""{_VERSIONS}, lo AS (SELECT * FROM o WHERE key NOT IN (SELECT key FROM n)), ln_ AS (SELECT * FROM n WHERE key NOT IN (SELECT key FROM o)),
 c AS (SELECT lo.bucket, lo.function_name AS old_name, ln_.function_name AS new_name, {similarity_sql('lo.', 'ln_.')} AS sim FROM lo JOIN ln_ ON lo.bucket = ln_.bucket)"""


@query(f"WITH {_FUZZY} SELECT old_name, new_name, round(sim, 6)::DOUBLE AS similarity FROM c WHERE sim >= 0.6")
def diff_fuzzy_candidates(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    c = diff.bucket_candidates(diff.unmatched(old, new), diff.unmatched(new, old))
    return c.select(F.col("old_function_name").alias("old_name"), F.col("new_function_name").alias("new_name"), F.round("similarity", 6).alias("similarity"))


@query()
def diff_assignment(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return diff.assign(diff.bucket_candidates(diff.unmatched(old, new), diff.unmatched(new, old)))


@query()
def diff_report(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff(*_versions(spark, d))


@query()
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return diff.summary(diff.diff(*_versions(spark, d)))


_G = "(n.entropy_score - o.entropy_score)"
_CALLS = f"(len(map_keys({_map('n.call_signatures')})) - len(map_keys({_map('o.call_signatures')})))"
_LOOP, _BRANCH = "(coalesce(n.loop_count, 0) - coalesce(o.loop_count, 0))", "(coalesce(n.branch_count, 0) - coalesce(o.branch_count, 0))"
_CAME = "(coalesce(n.{c}, false) AND NOT coalesce(o.{c}, false))"


@query(f"""WITH {_VERSIONS} SELECT o.function_name AS old_name, (greatest({_CALLS}, 0) * 5 + greatest({_LOOP}, 0) * 10 + greatest({_BRANCH}, 0) * 2 + CASE WHEN {_CAME.format(c='has_go')} THEN 15 ELSE 0 END + CASE WHEN {_CAME.format(c='has_defer')} THEN 3 ELSE 0 END
  + CASE WHEN {_CAME.format(c='has_panic')} THEN 5 ELSE 0 END + CASE WHEN {_G} > 1 AND NOT isnan({_G}) THEN trunc({_G} * 3) ELSE 0 END)::INTEGER AS risk,
  coalesce(nullif(concat_ws(', ', CASE WHEN {_CALLS} > 0 THEN 'Calls+' || {_CALLS} WHEN {_CALLS} < 0 THEN 'Calls' || {_CALLS} END, CASE WHEN {_LOOP} > 0 THEN 'Loops+' || {_LOOP} WHEN {_LOOP} < 0 THEN 'Loops' || {_LOOP} END,
   CASE WHEN {_BRANCH} > 0 THEN 'Branches+' || {_BRANCH} WHEN {_BRANCH} < 0 THEN 'Branches' || {_BRANCH} END, CASE WHEN {_CAME.format(c='has_go')} THEN 'AddedGoroutine' END, CASE WHEN {_CAME.format(c='has_defer')} THEN 'AddedDefer' END,
   CASE WHEN {_CAME.format(c='has_panic')} THEN 'AddedPanic' END, CASE WHEN {_G} > 1 AND NOT isnan({_G}) THEN 'Entropy+' || printf('%.1f', {_G}) END), ''), 'NoStructuralChange') AS label FROM o JOIN n USING (key)""")
def risk_delta(spark: SparkSession, d: str) -> DataFrame:
    delta = scoring.risk_delta(scoring.side("old_features"), scoring.side("new_features"))
    return diff.match_by_name(*_versions(spark, d)).select(F.col("old_function_name").alias("old_name"), delta["risk"].alias("risk"), delta["label"].alias("label"))


# ---------------------------------------------------------------- dependencies

_KEEP = "WHERE contains(split_part(import_path, '/', 1), '.') AND NOT starts_with(import_path, 'root.example')"


@query(f"WITH {fx.IMPORTS_SQL} SELECT DISTINCT import_path AS pkg_path FROM imports {_KEEP} AND starts_with(pkg_path, 'root.example')")
def dep_direct(spark: SparkSession, d: str) -> DataFrame:
    i = fx.imports(spark, d)
    return closure.dependencies(i, i.where(F.col("pkg_path").startswith("root.example")).select("pkg_path"), "root.example", transitive=False)


@query(f"""WITH RECURSIVE {fx.IMPORTS_SQL}, e AS (SELECT * FROM imports {_KEEP}), r(pkg_path) AS (SELECT import_path FROM e WHERE starts_with(pkg_path, 'root.example') UNION SELECT e.import_path FROM r JOIN e ON e.pkg_path = r.pkg_path)
 SELECT DISTINCT pkg_path FROM r""")
def dep_transitive(spark: SparkSession, d: str) -> DataFrame:
    i = fx.imports(spark, d)
    return closure.dependencies(i, i.where(F.col("pkg_path").startswith("root.example")).select("pkg_path"), "root.example")


@query(f"""WITH RECURSIVE {fx.IMPORTS_SQL}, e AS (SELECT * FROM imports WHERE contains(split_part(import_path, '/', 1), '.')), r(pkg_path) AS (SELECT import_path FROM e WHERE starts_with(pkg_path, 'root.example') UNION SELECT e.import_path FROM r JOIN e ON e.pkg_path = r.pkg_path)
 SELECT DISTINCT pkg_path FROM r""")
def dep_no_root(spark: SparkSession, d: str) -> DataFrame:
    """The closure without a root module, which leaves out standard packages only."""
    i = fx.imports(spark, d)
    return closure.dependencies(i, i.where(F.col("pkg_path").startswith("root.example")).select("pkg_path"), "")


# ---------------------------------------------------------------- loops


@query(f"""WITH {fx.LOOPS_SQL}, t AS (SELECT *, CASE WHEN op IN ('<', '<=') THEN lim - start ELSE start - lim END AS span, CASE WHEN op IN ('<', '<=') THEN step ELSE -step END AS pace, CASE WHEN op IN ('<=', '>=') THEN 1 ELSE 0 END AS c FROM loops),
 r AS (SELECT start, lim, step, op, CASE WHEN op = '!=' THEN CASE WHEN start = lim THEN 0 WHEN step = 1 THEN greatest(lim - start, 0) WHEN step = -1 THEN greatest(start - lim, 0) END
  WHEN span < 0 OR (span = 0 AND c = 0) THEN 0 WHEN pace <= 0 THEN NULL ELSE greatest((span + pace - 1 + c) // pace, 0) END::BIGINT AS trips FROM t)
 SELECT start, lim AS "limit", step, op, trips, count(*) AS n FROM r GROUP BY ALL""")
def trip_count(spark: SparkSession, d: str) -> DataFrame:
    t = scoring.trip_count(F.col("start"), F.col("limit"), F.col("step"), F.col("op"))
    return fx.loops(spark, d).withColumn("trips", t).groupBy("start", "limit", "step", "op", "trips").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.LOOPS_SQL} SELECT start, step, lim AS k, (start + step * lim)::VARCHAR AS value, count(*) AS n FROM loops GROUP BY ALL")
def affine_eval(spark: SparkSession, d: str) -> DataFrame:
    v = scoring.affine_at(F.col("start"), F.col("step"), F.col("limit")).cast("string")
    return fx.loops(spark, d).select("start", "step", F.col("limit").alias("k"), v.alias("value")).groupBy("start", "step", "k", "value").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- files


@query(rf"WITH {fx.PATHS_SQL} SELECT path, length FROM paths WHERE path LIKE '%.go' AND path NOT LIKE '%\_test.go' ESCAPE '\' AND NOT regexp_matches(path, '(^|/)(vendor|\.[^/]+)/')")
def file_filter(spark: SparkSession, d: str) -> DataFrame:
    return fx.paths(spark, d).where(files.is_source(F.col("path")))


@query(rf"WITH {fx.PATHS_SQL} SELECT path, CASE WHEN length > 10485760 THEN 'file too large: ' || length || ' bytes' END AS error FROM paths WHERE path LIKE '%.go' AND path NOT LIKE '%\_test.go' ESCAPE '\' AND path NOT LIKE '%\_generated.go' ESCAPE '\' AND path NOT LIKE 'vendor/%'")
def ci_files(spark: SparkSession, d: str) -> DataFrame:
    return fx.paths(spark, d).where(files.is_ci_source(F.col("path"))).select("path", files.size_error(F.col("length")).alias("error"))


@query("""SELECT o_orderkey AS k, x.status AS status, x.old_path AS old_path, x.new_path AS new_path FROM (SELECT o_orderkey, unnest(list_filter([
   {'status': 'M', 'old_path': 'a' || o_custkey || '.go', 'new_path': 'a' || o_custkey || '.go'}, {'status': 'R100', 'old_path': 'b' || o_custkey || '.go', 'new_path': 'c.go'}, {'status': 'A', 'old_path': '', 'new_path': 'd.go'}], lambda x: true)) AS x FROM orders)""")
def name_status(spark: SparkSession, d: str) -> DataFrame:
    o = fx.read(spark, d, "orders")
    z = F.lit("\0")
    stream = F.concat(F.lit("M"), z, F.lit("a"), "o_custkey", F.lit(".go"), z, F.lit("D"), z, F.lit("gone.go"), z, F.lit("R100"), z, F.lit("b"), "o_custkey", F.lit(".go"), z, F.lit("c.go"), z, F.lit("A"), z, F.lit("d.go"), z)
    return o.select(F.col("o_orderkey").alias("k"), F.explode(files.name_status(stream)).alias("x")).select("k", "x.*")


@query("SELECT parent_id, floor(avg(coalesce(votes, 0)) * 10) / 10 AS score, count(*) AS n FROM documents WHERE parent_id IS NOT NULL GROUP BY parent_id")
def mean_match(spark: SparkSession, d: str) -> DataFrame:
    """Mean over the files of a change, failures as 0, cut (not rounded) to one decimal."""
    v = F.avg(F.coalesce("votes", F.lit(0)))
    return fx.read(spark, d, "documents").where("parent_id is not null").groupBy("parent_id").agg((F.floor(v * 10) / 10).alias("score"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- audit


@query("""SELECT diff_id, function, risk_score, topology_delta, array_to_string(list_slice(ops, 1, 10), ', ') || CASE WHEN len(ops) > 10 THEN ' (+' || (len(ops) - 10) || ' more)' ELSE '' END AS added_operations
 FROM (SELECT DISTINCT ON (diff_id) diff_id, function, risk_score, topology_delta, list_filter(coalesce(added_ops, []), lambda x: x IS NOT NULL) AS ops FROM function_diffs) WHERE risk_score >= 10""")
def audit_evidence(spark: SparkSession, d: str) -> DataFrame:
    f = fx.read(spark, d, "function_diffs").where(F.col("risk_score") >= diff.HIGH_RISK).dropDuplicates(["diff_id"])
    ops = F.array_compact(F.coalesce("added_ops", F.array().cast("array<string>")))
    return f.select("diff_id", "function", "risk_score", "topology_delta", text.listed_ops(ops).alias("added_operations"))


@query("""WITH m AS (SELECT module_path, bool_and(coalesce(risk_score, 0) < 10) AS pass, count(*) AS n FROM (SELECT DISTINCT ON (diff_id) diff_id, module_path, risk_score FROM function_diffs) GROUP BY module_path)
 SELECT CASE WHEN pass THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS modules, sum(n)::BIGINT AS functions FROM m GROUP BY 1""")
def audit_tally(spark: SparkSession, d: str) -> DataFrame:
    f = fx.read(spark, d, "function_diffs").select("diff_id", "module_path", "risk_score").dropDuplicates(["diff_id"])
    m = f.groupBy("module_path").agg(F.bool_and(F.coalesce("risk_score", F.lit(0)) < 10).alias("pass"), F.count(F.lit(1)).alias("n"))
    return m.groupBy(F.when(F.col("pass"), "PASS").otherwise("FAIL").alias("verdict")).agg(F.count(F.lit(1)).alias("modules"), F.sum("n").alias("functions"))


_PHRASES = ", ".join(f"'{p}'" for p in text.FORBIDDEN)


@query(rf"""WITH r AS (SELECT doc_id, ['MATCH', 'lie', 'Suspicious', 'maybe', NULL][(doc_id % 5 + 1)::INT] AS v, CASE WHEN doc_id % 9 = 0 THEN text || ' System' || chr(160) || 'Prompt' WHEN doc_id % 9 = 1 THEN text || chr(7) ELSE text END AS e FROM documents),
 l AS (SELECT *, regexp_replace(lower(e), '[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+', ' ', 'g') AS low FROM r)
 SELECT doc_id, CASE WHEN upper(coalesce(v, '')) NOT IN ('MATCH', 'SUSPICIOUS', 'LIE') THEN 'verdict' WHEN length(e) > 4000 THEN 'length' WHEN regexp_matches(e, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') THEN 'control'
  WHEN len(list_filter([{_PHRASES}], lambda p: contains(low, p))) > 0 THEN 'phrase:' || list_filter([{_PHRASES}], lambda p: contains(low, p))[1] END AS fault FROM l""")
def validate_output(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("doc_id"), F.col("text")
    v = F.element_at(F.array(*[F.lit(x) for x in ("MATCH", "lie", "Suspicious", "maybe", None)]), (k % 5 + 1).cast("int"))
    e = F.when(k % 9 == 0, F.concat(t, F.lit(" System Prompt"))).when(k % 9 == 1, F.concat(t, F.lit("\x07"))).otherwise(t)
    return fx.read(spark, d, "documents").select("doc_id", text.output_fault(v, e).alias("fault"))


def _reply() -> Column:
    """JSON as it comes back: bare, fenced, fenced twice, in a sentence."""
    body = F.to_json(F.struct(F.lit("MATCH").alias("verdict"), F.col("event_type").alias("evidence")))
    return (
        F.when(F.col("event_id") % 4 == 0, body).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("Sure! Here: "), body, F.lit(" Bye."))).otherwise(F.concat(F.lit("```\nnot json\n```\n"), body))
    )


@query("""SELECT event_id, '{"verdict":"MATCH","evidence":"' || event_type || '"}' AS body FROM events""")
def json_fence(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "events").select("event_id", text.json_body(_reply()).alias("body"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '[TRUNCATED]' ELSE text END AS message, length(text) > 2000 AS cut FROM documents WHERE text IS NOT NULL")
def commit_message(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return fx.read(spark, d, "documents").where(t.isNotNull()).select("doc_id", text.shorten_message(t).alias("message"), (F.length(t) > 2000).alias("cut"))


@query("SELECT event_id, 'seen ' || event_type || CASE WHEN event_id % 2 = 1 THEN ' twice' ELSE '' END AS reply FROM events")
def reply_text(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    plain = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")), F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("seen "), e).alias("content"))).alias("output")))
    parts = F.array(F.struct(F.concat(F.lit("seen "), e).alias("text")), F.struct(F.lit(" twice").alias("text")))
    listed = F.to_json(F.struct(F.array(F.struct(F.lit("model").alias("role"), parts.alias("content"))).alias("output")))
    return fx.read(spark, d, "events").select("event_id", text.reply_text(F.when(F.col("event_id") % 2 == 1, listed).otherwise(plain)).alias("reply"))


@query("SELECT l_linenumber AS attempt, least(pow(2, l_linenumber) * 500, 5000)::BIGINT AS delay, count(*) AS n FROM lineitem GROUP BY ALL")
def retry_delay(spark: SparkSession, d: str) -> DataFrame:
    a = fx.read(spark, d, "lineitem").select(F.col("l_linenumber").alias("attempt"), text.retry_delay_ms(F.col("l_linenumber")).alias("delay"))
    return a.groupBy("attempt", "delay").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+', ' ', 'g') AS flat FROM documents")
def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "documents").select("doc_id", text.collapse_whitespace(F.col("text")).alias("flat"))
