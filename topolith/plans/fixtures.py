"""Tables the queries run on, in Spark and as SQL.

Feature rows and signatures come from the domain tables.  Program facts (instructions, edges,
loops, imports) are views over the star schema: an order is a function, a line item an
instruction.  Both sides derive them by the same rules, whole tables each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.facts import Facts, conform
from ..workspace import materialize


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# ---------------------------------------------------------------- feature rows


def functions(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows, one per ``func_id``: repeated deliveries have the same content."""
    return read(spark, d, "topology").dropDuplicates(["func_id"])


FUNCTIONS_SQL = "functions AS (SELECT * FROM topology QUALIFY row_number() OVER (PARTITION BY func_id ORDER BY loaded_at) = 1)"


def signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures with their lists cleaned of null entries; the rest as delivered."""
    f = "identifying_features."
    lists = {n: F.filter(F.coalesce(F.col(f + n), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")) for n in ("required_calls", "string_patterns")}
    return read(spark, d, "signatures").select(
        "row_id", "id", "name", "severity", "category", "topology_hash", "fuzzy_hash", "entropy_score", "entropy_tolerance", "node_count", "loop_depth",
        lists["required_calls"].alias("required_calls"), lists["string_patterns"].alias("string_patterns"), "obfuscation_score", "ingested_at",
    )


def _clean(col: str) -> str:
    return f"list_filter(coalesce({col}, []), lambda x: x IS NOT NULL AND x <> '')"


SIGNATURES_SQL = f"""sigs AS (SELECT row_id, id, name, severity, category, topology_hash, fuzzy_hash, entropy_score, entropy_tolerance, node_count, loop_depth,
 {_clean('identifying_features.required_calls')} AS required_calls, {_clean('identifying_features.string_patterns')} AS string_patterns, obfuscation_score, ingested_at FROM signatures)"""

# ---------------------------------------------------------------- program facts


def instrs(spark: SparkSession, d: str) -> DataFrame:
    """(func_id, pos, kind, op, call_sig, const_int): one row per line item, in a total order."""
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "A", "Call").when(F.col("l_returnflag") == "N", "BinOp").otherwise("If")
    sig = F.concat(
        F.element_at(F.array(*[F.lit(x) for x in ("", "go:", "defer:", "invoke:", "dynamic:")]), (F.col("l_suppkey") % 5 + 1).cast("int")),
        F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.lit("."), F.replace("p_brand", F.lit("#"), F.lit("_")),
    )
    return li.select(
        F.col("l_orderkey").alias("func_id"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long").alias("pos"),
        kind.alias("kind"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("^").alias("op"),
        F.when(kind == "Call", sig).alias("call_sig"),
        (F.floor("l_extendedprice") % 300).cast("long").alias("const_int"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )


INSTRS_SQL = """instrs AS (SELECT l_orderkey AS func_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS pos,
  CASE l_returnflag WHEN 'A' THEN 'Call' WHEN 'N' THEN 'BinOp' ELSE 'If' END AS kind,
  CASE l_linestatus WHEN 'O' THEN '+' ELSE '^' END AS op,
  CASE WHEN l_returnflag = 'A' THEN ['', 'go:', 'defer:', 'invoke:', 'dynamic:'][(l_suppkey % 5 + 1)::INT] || lower(replace(p_type, ' ', '_')) || '.' || replace(p_brand, '#', '_') END AS call_sig,
  (floor(l_extendedprice)::BIGINT % 300) AS const_int, trunc(l_quantity)::BIGINT AS quantity
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(func_id, src, dst): a chain of blocks with a back edge to block 1 from every block of quantity over 40."""
    i = instrs(spark, d)
    size = F.max("pos").over(Window.partitionBy("func_id"))
    chain = i.withColumn("n", size).where("pos < n").select("func_id", F.col("pos").alias("src"), (F.col("pos") + 1).alias("dst"))
    back = i.where("quantity > 40").select("func_id", F.col("pos").alias("src"), F.lit(1).cast("long").alias("dst"))
    return chain.unionByName(back)


EDGES_SQL = """edges AS (SELECT func_id, pos AS src, pos + 1 AS dst FROM (SELECT *, max(pos) OVER (PARTITION BY func_id) AS n FROM instrs) WHERE pos < n
 UNION ALL SELECT func_id, pos, 1 FROM instrs WHERE quantity > 40)"""


def fact_functions(spark: SparkSession, d: str) -> DataFrame:
    """(func_id, function_name, param_types, return_types): one row per order, up to three parameters and two results."""
    o = F.col("o_orderkey")
    types = F.array(*[F.lit(x) for x in ("int", "a/b.T", "string")])
    return read(spark, d, "orders").select(
        o.alias("func_id"), F.concat(F.lit("p.f"), o).alias("function_name"), F.slice(types, F.lit(1), (o % 4).cast("int")).alias("param_types"), F.slice(types, F.lit(1), (o % 3).cast("int")).alias("return_types")
    ).dropDuplicates(["func_id"])


def literals(spark: SparkSession, d: str) -> DataFrame:
    """(func_id, ord, lit): the lines of a document are the string literals of a function."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return read(spark, d, "documents").select(F.col("doc_id").alias("func_id"), F.posexplode(lines).alias("ord", "lit"))


def literal_lists(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("func_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("literals"))


def loops(spark: SparkSession, d: str) -> DataFrame:
    """Counted loops: (loop_id, start, limit, step, op) with every operator and both directions."""
    li = read(spark, d, "lineitem")
    step = (1 + F.col("l_suppkey") % 3) * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    op = F.element_at(F.array(*[F.lit(x) for x in ("<", "<=", ">", ">=", "!=")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    return li.select(F.col("l_linenumber").cast("long").alias("start"), F.col("l_quantity").cast("long").alias("limit"), step.cast("long").alias("step"), op.alias("op"))


LOOPS_SQL = """loops AS (SELECT l_linenumber::BIGINT AS start, trunc(l_quantity)::BIGINT AS lim,
 ((1 + l_suppkey % 3) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)::BIGINT AS step, ['<', '<=', '>', '>=', '!='][(l_partkey % 5 + 1)::INT] AS op FROM lineitem)"""


def programs(spark: SparkSession, d: str, changed: bool = False) -> Facts:
    """One function of four blocks per order: a chain of operations and calls, then a counted loop.

    Block 0 holds a line item per instruction, each using the one before, the first the parameter.  Block 1 is the
    header of a loop: a phi from a constant (or, in odd orders, the parameter), a comparison with a constant and a branch; block
    2 steps the counter; block 3 returns the end of the chain.  The changed version has other register names and, for orders of status F,
    another first operation.
    """
    mark = F.lit("n" if changed else "t")
    other = F.lit(changed) & (F.col("o_orderstatus") == "F")
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("func_id"), "o_orderstatus").dropDuplicates(["func_id"])
    items = materialize(instrs(spark, d).join(orders, "func_id").select("func_id", F.col("pos").cast("int").alias("pos"), "kind", "op", "call_sig", "const_int", "o_orderstatus"), "program-items")
    heads = materialize(items.groupBy("func_id", "o_orderstatus").agg(F.max("pos").alias("n")), "program-heads")
    k = F.col("func_id")
    reg = lambda x: F.concat(mark, x)
    text = lambda x: F.lit(x).cast("string")

    def instr(rows: DataFrame, block: int, pos: Column, name: Column, kind: Column, op: Column, kind_type: str | None, shown: Column) -> DataFrame:
        return rows.select("func_id", F.lit(block).alias("block_idx"), pos.alias("pos"), name.alias("instr_id"), kind.alias("kind"), op.alias("op"), text(kind_type).alias("value_type"), shown.alias("text"))

    def operand(rows: DataFrame, owner: Column, slot: int, role: str, kind: Column, ref: Column, number: Column, typed: str = "int") -> DataFrame:
        const = F.when(kind == "const", "int")
        return rows.select("func_id", owner.alias("instr_id"), F.lit(slot).alias("slot"), F.lit(role).alias("slot_role"), kind.alias("ref_kind"), ref.alias("ref_id"), const.alias("const_kind"), number.cast("string").alias("const_int"), F.lit(typed).alias("value_type"))

    call = F.col("kind") == "Call"
    target = F.when(other & (F.col("pos") == 1), "q.other").otherwise(F.col("call_sig"))
    op = F.when(other & (F.col("pos") == 1), "-").otherwise(F.col("op"))
    chain = instr(items, 0, F.col("pos"), reg(F.col("pos")), F.when(call, "Call").otherwise("BinOp"), F.when(call, "").otherwise(op), "int", F.when(call, F.concat(F.lit("call "), target)).otherwise(F.concat(op, F.lit(" int"))))
    chain = chain.join(items.select("func_id", "pos", F.when(call, "static").alias("call_mode"), F.when(call, target).alias("call_target")), ["func_id", "pos"])
    fixed = lambda block, pos, name, kind, op, kind_type, shown: instr(heads, block, F.lit(pos), reg(F.lit(name)), F.lit(kind), op, kind_type, F.lit(shown))
    test = F.element_at(F.array(*[F.lit(x) for x in LOOP_TESTS]), (k % 5 + 1).cast("int"))
    rest = [
        instr(heads, 0, F.col("n") + 1, reg(F.lit("j0")), F.lit("Jump"), F.lit(""), None, F.lit("jump 1")), fixed(1, 0, "i", "Phi", F.lit(""), "int", "phi"), fixed(1, 1, "c", "BinOp", test, "bool", "compare"),
        fixed(1, 2, "if", "If", F.lit(""), None, "if"), fixed(2, 0, "s", "BinOp", F.lit("+"), "int", "+ int"), fixed(2, 1, "j2", "Jump", F.lit(""), None, "jump 1"), fixed(3, 0, "r", "Return", F.lit(""), None, "return"),
    ]
    for r in rest:
        chain = chain.unionByName(r, allowMissingColumns=True)
    first, odd = F.col("pos") == 1, k % 2 == 1
    none = text(None)
    ops = operand(items, reg(F.col("pos")), 0, "x", F.when(first, "param").otherwise("instr"), F.when(first, "0").otherwise(reg(F.col("pos") - 1)), none)
    ops = ops.unionByName(operand(items.where(~call), reg(F.col("pos")), 1, "y", F.lit("const"), F.lit(""), F.col("const_int")))
    ops = ops.unionByName(operand(items.where(call), reg(F.col("pos")), 1, "callee", F.lit("func"), target, none, "func"))
    own = lambda name: reg(F.lit(name))
    # Edges of the phi follow the predecessors of its block, the one before the loop first.
    for o in (
        operand(heads, own("i"), 0, "edge", F.when(odd, "param").otherwise("const"), F.when(odd, "0").otherwise(""), F.when(~odd, k % 3)),
        operand(heads, own("i"), 1, "edge", F.lit("instr"), own("s"), none), operand(heads, own("c"), 0, "x", F.lit("instr"), own("i"), none),
        operand(heads, own("c"), 1, "y", F.lit("const"), F.lit(""), k % 50), operand(heads, own("if"), 0, "cond", F.lit("instr"), own("c"), none, "bool"),
        operand(heads, own("s"), 0, "x", F.lit("instr"), own("i"), none), operand(heads, own("s"), 1, "y", F.lit("const"), F.lit(""), loop_step(k)),
        operand(heads, own("r"), 0, "result", F.lit("instr"), reg(F.col("n")), none),
    ):
        ops = ops.unionByName(o)
    ways = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("src", "dst", "ord"), e)]) for e in ((0, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 0))]))
    edges_ = heads.select("func_id", ways.alias("e")).select("func_id", "e.*")
    ints = F.array(F.lit("int"), F.lit("int"))
    name = F.concat(F.lit("x.y/p.F"), "func_id")
    functions_ = heads.select("func_id", name.alias("function_name"), ints.alias("param_types"), F.array(F.lit("int")).alias("return_types"))
    return Facts(*[conform(t, n) for t, n in ((functions_, "functions"), (chain, "instrs"), (ops, "operands"), (edges_, "edges"))])


# Fixed choice of the fixture: tests of the loops, and their steps in SQL.
LOOP_TESTS = ("<", "<=", ">", ">=", "!=")


def loop_step(k: Column) -> Column:
    return (1 + k % 3) * F.when(k % 7 == 0, -1).otherwise(1)


def imports(spark: SparkSession, d: str) -> DataFrame:
    """(pkg_path, import_path, module): suppliers import nations, nations regions, regions each other; some are standard."""
    s, n, r = read(spark, d, "supplier"), read(spark, d, "nation"), read(spark, d, "region")
    host = lambda key: F.when(key % 3 == 0, F.concat(F.lit("std/n"), key)).otherwise(F.concat(F.lit("example.org/n"), key))
    region = lambda key: F.concat(F.lit("example.org/r"), key)
    a = s.select(F.concat(F.lit("root.example/s"), "s_suppkey").alias("pkg_path"), host(F.col("s_nationkey")).alias("import_path"))
    b = n.select(host(F.col("n_nationkey")).alias("pkg_path"), region(F.col("n_regionkey")).alias("import_path"))
    c = r.select(region(F.col("r_regionkey")).alias("pkg_path"), region((F.col("r_regionkey") + 1) % 5).alias("import_path"))
    return a.union(b).union(c)


IMPORTS_SQL = """imports AS (SELECT 'root.example/s' || s_suppkey AS pkg_path, CASE WHEN s_nationkey % 3 = 0 THEN 'std/n' ELSE 'example.org/n' END || s_nationkey AS import_path FROM supplier
 UNION ALL SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'std/n' ELSE 'example.org/n' END || n_nationkey, 'example.org/r' || n_regionkey FROM nation
 UNION ALL SELECT 'example.org/r' || r_regionkey, 'example.org/r' || ((r_regionkey + 1) % 5) FROM region)"""


def paths(spark: SparkSession, d: str) -> DataFrame:
    """File paths: one per part, with test, vendored, hidden and generated ones among them."""
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src/", "vendor/x/", "src/.git/", "a/vendor/", "cmd/")]), (k % 5 + 1).cast("int"))
    tail = F.element_at(F.array(*[F.lit(x) for x in (".go", "_test.go", "_generated.go", ".txt")]), (k % 4 + 1).cast("int"))
    return p.select(F.concat(folder, F.lit("f"), k, tail).alias("path"), (F.col("p_size") * 400_000).cast("long").alias("length"))


PATHS_SQL = """paths AS (SELECT ['src/', 'vendor/x/', 'src/.git/', 'a/vendor/', 'cmd/'][(p_partkey % 5 + 1)::INT] || 'f' || p_partkey || ['.go', '_test.go', '_generated.go', '.txt'][(p_partkey % 4 + 1)::INT] AS path,
 (p_size * 400000)::BIGINT AS length FROM part)"""
