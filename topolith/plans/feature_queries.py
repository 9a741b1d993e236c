"""Queries on names, entropy, histograms, hashes and obfuscation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import entropy, names, scoring
from ..operators import features
from ..workspace import materialize
from . import fixtures as fx
from .registry import query

# ---------------------------------------------------------------- SQL pieces

_BYTES = "SELECT doc_id AS func_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents"


def _map(col: str) -> str:
    return f"coalesce({col}, MAP {{}}::MAP(VARCHAR, INTEGER))"


def _list(col: str) -> str:
    return f"coalesce({col}, []::VARCHAR[])"


def hash_sql(p: str = "") -> str:
    n = lambda c: f"coalesce({p}{c}, 0)"
    flag = lambda c, x: f"CASE WHEN coalesce({p}{c}, false) THEN '{x}' ELSE '' END"
    calls = f"list_transform(map_entries({_map(p + 'call_signatures')}), lambda e: strlen(e.key) || ':' || e.key || ':' || coalesce(e.value, 0))"
    return (
        f"'P' || {n('param_count')} || 'R' || {n('return_count')} || 'B' || {n('block_count')} || 'I' || {n('instr_count')} || 'L' || {n('loop_count')} || 'BR' || {n('branch_count')}"
        f" || array_to_string(list_sort({calls}), ';') || {flag('has_defer', 'D')} || {flag('has_go', 'G')} || {flag('has_select', 'S')} || {flag('has_panic', 'P')}"
    )


def bucket_sql(p: str = "") -> str:
    n = lambda c: f"coalesce({p}{c}, 0)"
    log = lambda c: f"CASE WHEN {n(c)} > 0 THEN length(bin({n(c)})) - 1 ELSE 0 END"
    br = f"CASE WHEN {n('branch_count')} > 0 THEN length(bin({n('branch_count')})) ELSE 0 END"
    return f"'B' || ({log('block_count')}) || 'L' || least({n('loop_count')}, 5) || 'BR' || ({br}) || 'P' || {n('param_count')} || 'R' || {n('return_count')}"


def class_sql(c: str) -> str:
    return f"CASE WHEN {c} < 4.0 THEN 'LOW' WHEN {c} < 6.5 THEN 'NORMAL' WHEN {c} < 7.5 THEN 'HIGH' ELSE 'PACKED' END"


# ---------------------------------------------------------------- entropy


def _text(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "documents").select(F.col("doc_id").alias("func_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


_DOC_ENTROPY = f"""docs AS ({_BYTES}), ex AS (SELECT func_id, unnest(b) AS x FROM docs), cnt AS (SELECT func_id, x, count(*) AS n FROM ex GROUP BY ALL),
 tot AS (SELECT func_id, sum(n) AS t FROM cnt GROUP BY ALL),
 ent AS (SELECT func_id, coalesce(0.0 - sum(n / t * log2(n / t)), 0.0::DOUBLE) + 0.0 AS raw, round(coalesce(0.0 - sum(n / t * log2(n / t)), 0.0::DOUBLE), 6) + 0.0 AS entropy FROM docs LEFT JOIN cnt USING (func_id) LEFT JOIN tot USING (func_id) GROUP BY func_id)"""


@query(f"WITH {_DOC_ENTROPY} SELECT func_id, entropy::DOUBLE AS entropy, {class_sql('entropy')} AS class, round(raw / 8, 6)::DOUBLE AS normalized FROM ent")
def entropy_documents(spark: SparkSession, d: str) -> DataFrame:
    e = _text(spark, d).select("func_id", entropy.byte_entropy(F.col("data")).alias("raw"))
    e = e.withColumn("entropy", F.round("raw", 6))
    return e.select("func_id", "entropy", entropy.entropy_class(F.col("entropy")).alias("class"), F.round(entropy.entropy_normalized(F.col("raw")), 6).alias("normalized"))


@query(f"WITH {_DOC_ENTROPY} SELECT {class_sql('entropy')} AS class, count(*) AS n FROM ent GROUP BY 1")
def entropy_class_hist(spark: SparkSession, d: str) -> DataFrame:
    e = _text(spark, d).select(F.round(entropy.byte_entropy(F.col("data")), 6).alias("entropy"))
    return e.groupBy(entropy.entropy_class(F.col("entropy")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH lit AS (SELECT doc_id AS func_id, unnest(string_split(coalesce(text, ''), chr(10))) AS lit, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents),
 b AS (SELECT func_id, ord, unnest(regexp_extract_all(hex(encode(lit)), '..')) AS x FROM lit), c AS (SELECT func_id, ord, x, count(*) AS n FROM b GROUP BY ALL),
 t AS (SELECT func_id, ord, sum(n) AS t FROM c GROUP BY ALL), e AS (SELECT func_id, ord, -sum(n / t * log2(n / t)) AS e FROM c JOIN t USING (func_id, ord) GROUP BY ALL)
 SELECT func_id, round(sum(coalesce(e, 0)) / count(*), 5)::DOUBLE + 0.0 AS literal_entropy FROM lit LEFT JOIN e USING (func_id, ord) GROUP BY func_id""")
def literal_entropy_mean(spark: SparkSession, d: str) -> DataFrame:
    return fx.literal_lists(spark, d).select("func_id", (F.round(entropy.literal_entropy(F.col("literals")), 5) + 0.0).alias("literal_entropy"))


@query(f"""WITH docs AS ({_BYTES}), w AS (SELECT func_id, b, unnest(generate_series(0, greatest(0, ceil((len(b) - 256) / 128.0)::BIGINT) * 128, 128)) AS s FROM docs),
 ex AS (SELECT func_id, s, unnest(list_slice(b, s + 1, s + 256)) AS x FROM w), c AS (SELECT func_id, s, x, count(*) AS n FROM ex GROUP BY ALL), t AS (SELECT func_id, s, sum(n) AS t FROM c GROUP BY ALL),
 e AS (SELECT func_id, s, 0.0 - sum(n / t * log2(n / t)) AS e FROM c JOIN t USING (func_id, s) GROUP BY ALL), m AS (SELECT func_id, max(e) AS e FROM e GROUP BY ALL)
 SELECT func_id, round(coalesce(e, 0), 6)::DOUBLE + 0.0 AS window_entropy FROM docs LEFT JOIN m USING (func_id)""")
def max_window_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _text(spark, d).select("func_id", (F.round(entropy.max_window_entropy(F.col("data")), 6) + 0.0).alias("window_entropy"))


@query("""SELECT row_id, CASE WHEN entropy_score IS NULL THEN NULL ELSE printf('%08.4f', entropy_score) || ':' || coalesce(id, '') END AS key,
 abs(entropy_score - obfuscation_score * 8) AS distance, coalesce(abs(entropy_score - obfuscation_score * 8) <= CASE WHEN coalesce(entropy_tolerance, 0) = 0 THEN 0.5 ELSE entropy_tolerance END, false) AS within FROM signatures""")
def entropy_keys(spark: SparkSession, d: str) -> DataFrame:
    s = fx.read(spark, d, "signatures")
    mine = F.col("obfuscation_score") * 8
    return s.select(
        "row_id", F.when(F.col("entropy_score").isNotNull(), names.entropy_key(F.col("entropy_score"), F.coalesce("id", F.lit("")))).alias("key"),
        entropy.entropy_distance(F.col("entropy_score"), mine).alias("distance"),
        F.coalesce(entropy.within_tolerance(mine, F.col("entropy_score"), F.col("entropy_tolerance"), 0.5), F.lit(False)).alias("within"),
    )


# ---------------------------------------------------------------- payload bytes


@query(f"""WITH {fx.INSTRS_SQL}, i AS (SELECT *, sum(CASE WHEN const_int NOT BETWEEN 0 AND 255 THEN 1 ELSE 0 END) OVER (PARTITION BY func_id ORDER BY pos) AS isl FROM instrs),
 r AS (SELECT func_id, isl, count(*) FILTER (const_int BETWEEN 0 AND 255) AS n FROM i GROUP BY ALL) SELECT func_id, max(n) AS byte_run FROM r GROUP BY func_id""")
def byte_run_max(spark: SparkSession, d: str) -> DataFrame:
    return features.longest_byte_run(fx.instrs(spark, d))


_POOL = f"""{fx.INSTRS_SQL}, i AS (SELECT func_id, pos, CASE WHEN const_int < 256 THEN [const_int] ELSE [const_int % 256, const_int // 256] END AS bs FROM instrs),
 x AS (SELECT func_id, unnest(bs) AS x FROM i)"""


@query(f"""WITH {_POOL}, c AS (SELECT func_id, x, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT func_id, sum(n) AS t FROM c GROUP BY ALL)
 SELECT func_id, round(0.0 - sum(n / t * log2(n / t)), 6)::DOUBLE + 0.0 AS pool_entropy, any_value(t)::BIGINT AS pool_bytes FROM c JOIN t USING (func_id) GROUP BY func_id""")
def const_pool_entropy(spark: SparkSession, d: str) -> DataFrame:
    pool = features.constant_pool(fx.instrs(spark, d))
    return pool.select("func_id", (F.round(entropy.byte_entropy(F.col("pool")), 6) + 0.0).alias("pool_entropy"), F.octet_length("pool").cast("long").alias("pool_bytes"))


@query("""SELECT event_id, array_to_string(list_reverse(regexp_extract_all(CASE WHEN length(h) % 2 = 1 THEN '0' || h ELSE h END, '..')), '') AS bytes
 FROM (SELECT event_id, hex(event_id * user_id * 7919) AS h FROM events)""")
def le_fold(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("event_id") * F.col("user_id") * 7919
    return fx.read(spark, d, "events").select("event_id", entropy.little_endian_hex(v).alias("bytes"))


# ---------------------------------------------------------------- histograms and flags


@query(f"WITH {fx.INSTRS_SQL} SELECT func_id, call_sig AS value, count(*) AS n FROM instrs WHERE call_sig IS NOT NULL GROUP BY ALL")
def call_histogram(spark: SparkSession, d: str) -> DataFrame:
    return features.histogram(fx.instrs(spark, d), "call_sig")


@query(f"""WITH {fx.INSTRS_SQL} SELECT func_id, array_to_string(list_sort(list(kind || ':' || op || '=' || n)), ',') AS profile FROM (SELECT func_id, kind, op, count(*) AS n FROM instrs GROUP BY ALL) GROUP BY func_id""")
def instr_profile(spark: SparkSession, d: str) -> DataFrame:
    i = fx.instrs(spark, d).withColumn("kind_op", F.concat_ws(":", "kind", "op"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return features.histogram_map(features.histogram(i, "kind_op")).select("func_id", text.alias("profile"))


@query(f"""WITH {fx.INSTRS_SQL} SELECT func_id, count(*) AS instr_count, count(*) FILTER (kind = 'If') AS branch_count, count(*) FILTER (kind = 'Call') AS call_count, count(*) FILTER (kind = 'BinOp') AS binop_count,
 coalesce(bool_or(starts_with(call_sig, 'go:')), false) AS has_go, coalesce(bool_or(starts_with(call_sig, 'defer:')), false) AS has_defer, coalesce(bool_or(starts_with(call_sig, 'invoke:')), false) AS has_invoke FROM instrs GROUP BY func_id""")
def feature_flags(spark: SparkSession, d: str) -> DataFrame:
    return features.profile(fx.instrs(spark, d))


@query(f"""WITH {fx.INSTRS_SQL}, {fx.EDGES_SQL}, b AS (SELECT func_id, max(pos) AS n FROM instrs GROUP BY 1), e AS (SELECT func_id, count(*) AS m FROM edges GROUP BY 1)
 SELECT func_id, coalesce(m, 0) - n + 2 AS cyclomatic FROM b LEFT JOIN e USING (func_id)""")
def cyclomatic(spark: SparkSession, d: str) -> DataFrame:
    blocks = fx.instrs(spark, d).groupBy("func_id").agg(F.max("pos").alias("n_blocks"))
    return features.cyclomatic(fx.edges(spark, d), blocks)


@query(f"""WITH {fx.INSTRS_SQL}, c AS (SELECT func_id, call_sig, count(*) AS n FROM instrs WHERE call_sig IS NOT NULL GROUP BY ALL)
 SELECT func_id, round(sum(CASE WHEN regexp_matches(call_sig, '^(dynamic:|reflect:|invoke:|go:dynamic:|defer:dynamic:)') THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS indirect_ratio FROM c GROUP BY func_id""")
def indirect_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = features.indirect_ratio(features.histogram(fx.instrs(spark, d), "call_sig"))
    return r.select("func_id", F.round("indirect_ratio", 6).alias("indirect_ratio"))


@query(f"""WITH {fx.INSTRS_SQL}, {fx.EDGES_SQL}, b AS (SELECT func_id, max(pos) AS n FROM instrs GROUP BY 1), f AS (SELECT func_id, max(c) AS m FROM (SELECT func_id, dst, count(*) AS c FROM edges GROUP BY ALL) GROUP BY 1)
 SELECT func_id, m AS max_fan_in, round(CASE WHEN n >= 6 AND m >= 4 THEN greatest(0, least(1, (m / n - 0.25) / 0.5)) ELSE 0 END, 6)::DOUBLE AS flattening FROM f JOIN b USING (func_id)""")
def fan_in(spark: SparkSession, d: str) -> DataFrame:
    blocks = fx.instrs(spark, d).groupBy("func_id").agg(F.max("pos").alias("n_blocks"))
    f = features.fan_in(fx.edges(spark, d)).join(blocks, "func_id")
    return f.select("func_id", "max_fan_in", F.round(features.flattening(F.col("max_fan_in"), F.col("n_blocks")), 6).alias("flattening"))


@query()
def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """Feature row and topology hash of every function, from all facts; a block is an instruction, as in ``cyclomatic``."""
    i = materialize(fx.instrs(spark, d).withColumn("block", F.col("pos")), "instrs")
    operands = i.select("func_id", "pos", F.lit(0).alias("slot"), F.lit("x").alias("slot_role"), "const_int")
    rows = features.feature_rows(fx.fact_functions(spark, d), i, operands, materialize(fx.edges(spark, d), "edges"), fx.literals(spark, d))
    return rows.withColumn("hash", scoring.topology_hash(scoring.side()))


_FITS = "a.used + strlen(x.lit) <= 512"


@query(f"""WITH lit AS (SELECT doc_id AS func_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: CASE WHEN strlen(l) <= 64 THEN l ELSE list_filter(list_transform(range(64, 12, -1), lambda k: substr(l, 1, k)), lambda s: strlen(s) <= 64)[1] END) AS lits FROM documents),
 st AS (SELECT func_id, list_prepend({{'used': 0::BIGINT, 'kept': 0::BIGINT, 'digest': '', 'lit': ''}}, list_transform(lits, lambda l: {{'used': 0::BIGINT, 'kept': 0::BIGINT, 'digest': '', 'lit': l}})) AS s FROM lit),
 f AS (SELECT func_id, list_reduce(s, lambda a, x: {{'used': CASE WHEN {_FITS} THEN a.used + strlen(x.lit) ELSE a.used END, 'kept': CASE WHEN {_FITS} THEN a.kept + 1 ELSE a.kept END, 'digest': CASE WHEN {_FITS} THEN md5(a.digest || x.lit) ELSE a.digest END, 'lit': ''}}) AS r FROM st)
 SELECT func_id, r.used AS used, r.kept AS kept, r.digest AS digest FROM f""")
def literal_budget(spark: SparkSession, d: str) -> DataFrame:
    kept = fx.literal_lists(spark, d).select("func_id", features.within_budget(F.col("literals"), 64, 512).alias("kept"))
    used = F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    digest = F.aggregate("kept", F.lit(""), lambda a, x: F.md5(F.concat(a, x)))
    return kept.select("func_id", used.alias("used"), F.size("kept").cast("long").alias("kept"), digest.alias("digest"))


# ---------------------------------------------------------------- hashes and labels

_SORTED_CALLS = f"list_sort(map_keys({_map('call_signatures')}))"


@query(f"WITH {fx.FUNCTIONS_SQL} SELECT func_id, substr(sha256({hash_sql()}), 1, 32) AS hash FROM functions")
def topology_hash(spark: SparkSession, d: str) -> DataFrame:
    return fx.functions(spark, d).select("func_id", scoring.topology_hash(scoring.side()).alias("hash"))


@query(f"WITH {fx.FUNCTIONS_SQL} SELECT func_id, {bucket_sql()} AS bucket FROM functions")
def fuzzy_hash(spark: SparkSession, d: str) -> DataFrame:
    f = scoring.side()
    return fx.functions(spark, d).select("func_id", names.fuzzy_hash(f["block_count"], f["loop_count"], f["branch_count"], f["param_count"], f["return_count"]).alias("bucket"))


@query(f"""WITH {fx.FUNCTIONS_SQL} SELECT func_id, 'L' || coalesce(loop_count, 0) || 'B' || coalesce(branch_count, 0) || 'I' || coalesce(instr_count, 0) || '[' || array_to_string(list_slice({_SORTED_CALLS}, 1, 3), ',')
 || CASE WHEN len({_SORTED_CALLS}) > 3 THEN ',...(' || len({_SORTED_CALLS}) || ')' ELSE '' END || ']' AS label FROM functions""")
def topology_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    f = scoring.side()
    calls = F.array_sort(F.map_keys(f["call_signatures"]))
    return fx.functions(spark, d).select("func_id", names.topology_label(f["loop_count"], f["branch_count"], f["instr_count"], calls).alias("label"))


_CUT = "CASE WHEN {v} <= {lo} THEN 0.0 WHEN {v} >= {hi} THEN 1.0 ELSE ({v} - {lo}) / ({hi} - {lo}) END"
_O = {
    "w": _CUT.format(v="o.max_window_entropy", lo="5.0", hi="8.0"), "c": _CUT.format(v="o.const_pool_entropy", lo="4.0", hi="8.0"), "r": _CUT.format(v="o.byte_array_payload_bytes::DOUBLE", lo="16.0", hi="256.0"),
}


@query(f"""WITH {fx.FUNCTIONS_SQL}, f AS (SELECT func_id, {{'max_window_entropy': coalesce(obfuscation.max_window_entropy, 0.0::DOUBLE), 'const_pool_entropy': coalesce(obfuscation.const_pool_entropy, 0.0::DOUBLE), 'byte_array_payload_bytes': coalesce(obfuscation.byte_array_payload_bytes, 0),
   'indirect_call_ratio': coalesce(obfuscation.indirect_call_ratio, 0.0::DOUBLE), 'flattening_score': coalesce(obfuscation.flattening_score, 0.0::DOUBLE), 'decoder_loop_likelihood': coalesce(obfuscation.decoder_loop_likelihood, 0.0::DOUBLE)}} AS o,
   coalesce(block_count, 0) AS blocks, coalesce(loop_count, 0) AS loops FROM functions),
 s AS (SELECT func_id, o, ({_O['w']})::DOUBLE AS v1, ({_O['c']})::DOUBLE AS v2, ({_O['r']})::DOUBLE AS v3, o.indirect_call_ratio AS v4, o.flattening_score AS v5, o.decoder_loop_likelihood AS v6,
  coalesce(o.max_window_entropy > 0, false) AS a1, coalesce(o.const_pool_entropy > 0, false) AS a2, coalesce(o.byte_array_payload_bytes > 0, false) AS a3, true AS a4, blocks >= 6 AS a5, loops > 0 AS a6 FROM f),
 t AS (SELECT *, (CASE WHEN a1 THEN 0.30::DOUBLE*v1 ELSE 0 END + CASE WHEN a2 THEN 0.20::DOUBLE*v2 ELSE 0 END + CASE WHEN a3 THEN 0.15::DOUBLE*v3 ELSE 0 END + CASE WHEN a4 THEN 0.15::DOUBLE*v4 ELSE 0 END + CASE WHEN a5 THEN 0.10::DOUBLE*v5 ELSE 0 END + CASE WHEN a6 THEN 0.10::DOUBLE*v6 ELSE 0 END)
   / (CASE WHEN a1 THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN a2 THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN a3 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN a4 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN a5 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN a6 THEN 0.10::DOUBLE ELSE 0 END) AS m,
   greatest(CASE WHEN a1 THEN v1 ELSE 0 END, CASE WHEN a2 THEN v2 ELSE 0 END, CASE WHEN a3 THEN v3 ELSE 0 END, CASE WHEN o.max_window_entropy >= 7.2 THEN 0.75 ELSE 0 END) AS floor_,
   (CASE WHEN a1 AND v1 >= 0.5 THEN 1 ELSE 0 END + CASE WHEN a2 AND v2 >= 0.5 THEN 1 ELSE 0 END + CASE WHEN a3 AND v3 >= 0.5 THEN 1 ELSE 0 END) AS hard,
   (CASE WHEN a4 AND v4 >= 0.5 THEN 1 ELSE 0 END + CASE WHEN a5 AND v5 >= 0.5 THEN 1 ELSE 0 END + CASE WHEN a6 AND v6 >= 0.5 THEN 1 ELSE 0 END) AS soft FROM s),
 u AS (SELECT *, greatest(m, floor_) AS raw FROM t), z AS (SELECT *, CASE WHEN hard = 0 AND soft < 2 THEN least(raw, 0.49) ELSE raw END AS sc FROM u)
 SELECT func_id, round(sc, 6)::DOUBLE AS score, CASE WHEN round(sc, 6) < 0.25 THEN 'NONE' WHEN round(sc, 6) < 0.5 THEN 'LOW' WHEN round(sc, 6) < 0.75 THEN 'MODERATE' ELSE 'HIGH' END AS class, (hard + soft)::BIGINT AS indicators FROM z""")
def obfuscation_score(spark: SparkSession, d: str) -> DataFrame:
    o = lambda c: F.coalesce("obfuscation." + c, F.lit(0))
    n = lambda c: F.coalesce(c, F.lit(0))
    profile = scoring.obfuscation_profile(
        o("max_window_entropy"), o("const_pool_entropy"), o("byte_array_payload_bytes"), o("indirect_call_ratio"), o("flattening_score"), o("decoder_loop_likelihood"),
        o("max_window_entropy") > 0, o("const_pool_entropy") > 0, F.lit(True), n("block_count") >= 6, n("loop_count") > 0,
    )
    p = fx.functions(spark, d).select("func_id", profile.alias("p"))
    return p.select("func_id", F.round("p.score", 6).alias("score"), scoring.obfuscation_class(F.round("p.score", 6)).alias("class"), F.size("p.indicators").cast("long").alias("indicators"))


# ---------------------------------------------------------------- names

_WORD = r"([()\[\]*, {}]|[^()\[\]*, {}]+)"
JOIN_NAME_SQL = rf"array_to_string(list_transform(regexp_extract_all({{c}}, '{_WORD}'), lambda w: regexp_replace(w, '^(\.*)(?:.*[/.])?([^/.]*)$', '\1\2')), '')".replace("{}", "{{}}")


def join_name_sql(c: str) -> str:
    return JOIN_NAME_SQL.format(c=c)


_TYPED = "CASE WHEN func_id % 3 = 0 THEN '(*' || function_name || ').Run' WHEN func_id % 3 = 1 THEN function_name || '[map[' || function_name || ']*a.b/c.T]' ELSE function_name END"


def _typed() -> Column:
    name = F.col("function_name")
    return F.when(F.col("func_id") % 3 == 0, F.concat(F.lit("(*"), name, F.lit(").Run"))).when(F.col("func_id") % 3 == 1, F.concat(name, F.lit("[map["), name, F.lit("]*a.b/c.T]"))).otherwise(name)


@query(f"WITH {fx.FUNCTIONS_SQL}, n AS (SELECT func_id, {_TYPED} AS name FROM functions) SELECT func_id, name, {join_name_sql('name')} AS key FROM n")
def short_name_key(spark: SparkSession, d: str) -> DataFrame:
    n = fx.functions(spark, d).select("func_id", _typed().alias("name"))
    return n.select("func_id", "name", names.join_name(F.col("name")).alias("key"))


@query(rf"""WITH {fx.FUNCTIONS_SQL} SELECT func_id, CASE WHEN func_id % 3 = 0 THEN '(*' || regexp_replace(regexp_replace(function_name, '^.*/', ''), '^[^.]*\.', '') || ').Run'
 WHEN func_id % 3 = 1 THEN regexp_replace(regexp_replace(function_name, '^.*/', ''), '^[^.]*\.', '') || '[map[' || function_name || ']*a.b/c.T]' ELSE regexp_replace(regexp_replace(function_name, '^.*/', ''), '^[^.]*\.', '') END AS display FROM functions""")
def short_name_display(spark: SparkSession, d: str) -> DataFrame:
    return fx.functions(spark, d).select("func_id", names.display_name(_typed()).alias("display"))


@query(rf"WITH {fx.FUNCTIONS_SQL}, t AS (SELECT func_id, unnest({_list('param_types')}) AS t, generate_subscripts({_list('param_types')}, 1) AS k, function_name AS f FROM functions) SELECT func_id, k::BIGINT AS k, regexp_replace('*' || coalesce(f, 'x') || '/' || t, '[\w.-]+/', '', 'g') AS type FROM t")
def type_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = fx.functions(spark, d).select("func_id", "function_name", F.posexplode("param_types").alias("k", "t"))
    full = F.concat(F.lit("*"), F.coalesce("function_name", F.lit("x")), F.lit("/"), F.col("t"))
    return t.select("func_id", (F.col("k") + 1).cast("long").alias("k"), names.type_name(full).alias("type"))


@query("""SELECT event_id, CASE WHEN user_id % 7 < 2 THEN 'invoke:T.' || event_type WHEN user_id % 7 = 2 THEN 'go:invoke:T.' || event_type WHEN user_id % 7 = 3 THEN 'defer:dynamic:func()' WHEN user_id % 7 = 4 THEN 'builtin:' || event_type
  WHEN user_id % 7 = 5 THEN 'reflect:Call' ELSE 'go:p.' || event_type END AS sig, user_id % 7 IN (0, 1, 3, 5) AS indirect FROM events""")
def call_signatures(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 7
    kind = F.when(k.isin(2, 6), "Go").when(k == 3, "Defer").otherwise("Call")
    mode = F.when(k.isin(0, 1, 2), "invoke").when(k.isin(3, 4), "builtin").when(k == 6, "static").otherwise("dynamic")
    target = F.when(k == 6, F.concat(F.lit("p."), "event_type")).otherwise(F.col("event_type"))
    value = F.when(k == 3, "func()").when(k == 5, "func(reflect.Value)").otherwise("x/y.F")
    sig = names.call_signature(kind, mode, target, F.lit("a.b/T"), F.col("event_type"), value)
    return fx.read(spark, d, "events").select("event_id", sig.alias("sig")).withColumn("indirect", names.is_indirect(F.col("sig")))


@query("""WITH n AS (SELECT l_orderkey AS k, l_linenumber AS l, (l_extendedprice * l_partkey * l_suppkey * l_linenumber)::BIGINT AS b FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS l_extendedprice, l_partkey, l_suppkey FROM lineitem)),
 e AS (SELECT *, CASE WHEN b < 1024 THEN 0 WHEN b < 1024**2 THEN 1 WHEN b < 1024**3 THEN 2 WHEN b < 1024**4 THEN 3 ELSE 4 END AS p FROM n)
 SELECT k, l, b, CASE p WHEN 0 THEN b || ' B' ELSE printf('%.1f', b / (1024.0::DOUBLE ** p)) || ' ' || ['K', 'M', 'G', 'T'][p] || 'B' END AS size FROM e""")
def humanize(spark: SparkSession, d: str) -> DataFrame:
    b = (F.floor("l_extendedprice") * F.col("l_partkey") * F.col("l_suppkey") * F.col("l_linenumber")).cast("long")
    return fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), b.alias("b"), names.humanize_bytes(b).alias("size"))


_COMMANDS = ["check", "diff", "audit", "index", "scan", "migrate", "stats"]
_LEV = ", ".join(f"{{'d': levenshtein(w, '{c}'), 'i': {i}, 'k': '{c}'}}" for i, c in enumerate(_COMMANDS))


@query(f"""WITH w AS (SELECT event_id, lower(substr(event_type, 1, 5)) AS w FROM events UNION ALL SELECT 1000000000 + c_custkey, ['chek', 'dif', 'Audit', 'indx', 'scam', 'stat', 'migrat', 'q'][(c_custkey % 8 + 1)::INT] FROM customer),
 b AS (SELECT event_id, lower(w) AS w FROM w), r AS (SELECT event_id, w, list_sort([{_LEV}])[1] AS best FROM b) SELECT event_id, w, CASE WHEN best.d <= 2 THEN best.k END AS suggestion FROM r""")
def suggest(spark: SparkSession, d: str) -> DataFrame:
    a = fx.read(spark, d, "events").select("event_id", F.substring("event_type", 1, 5).alias("w"))
    typos = F.array(*[F.lit(x) for x in ("chek", "dif", "Audit", "indx", "scam", "stat", "migrat", "q")])
    b = fx.read(spark, d, "customer").select((F.col("c_custkey") + 1_000_000_000).alias("event_id"), F.element_at(typos, (F.col("c_custkey") % 8 + 1).cast("int")).alias("w"))
    w = a.union(b).select("event_id", F.lower("w").alias("w"))
    return w.select("event_id", "w", names.suggest(F.col("w"), _COMMANDS).alias("suggestion"))


@query("""SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'example.org/' || replace(lower(p_brand), '#', '') END AS module FROM part""")
def module_line(spark: SparkSession, d: str) -> DataFrame:
    p = fx.read(spark, d, "part")
    path = F.concat(F.lit("example.org/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("// head\n\nmodule "), path, F.lit("\n\ngo 1.22\n"))).otherwise(F.concat(F.lit("// no line here, "), F.col("p_name")))
    return p.select(F.col("p_partkey").alias("k"), names.module_line(text).alias("module"))


@query("SELECT row_id, 'SFW-' || upper(substr(coalesce(category, ''), 1, 3)) || '-' || coalesce(floor(epoch(ingested_at))::BIGINT, 0) || '-' || row_number() OVER (PARTITION BY category ORDER BY row_id) AS new_id, strftime(ingested_at, '%Y-%m-%d') AS created FROM signatures")
def numbered_ids(spark: SparkSession, d: str) -> DataFrame:
    s = fx.read(spark, d, "signatures")
    k = F.row_number().over(Window.partitionBy("category").orderBy("row_id"))
    at = F.coalesce(F.floor(F.col("ingested_at").cast("timestamp").cast("double")).cast("long"), F.lit(0))
    return s.select("row_id", names.signature_id(F.coalesce("category", F.lit("")), at, k).alias("new_id"), F.date_format("ingested_at", "yyyy-MM-dd").alias("created"))
