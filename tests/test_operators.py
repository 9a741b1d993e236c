import json
import random

import pytest
from pyspark.sql import functions as F

from topolith import workspace
from topolith.operators import canonical, closure, diff, features, scan
from topolith.sources import files, store

SIG = "id string, name string, severity string, topology_hash string, fuzzy_hash string, entropy_score double, entropy_tolerance double, node_count int, loop_depth int, required_calls array<string>, string_patterns array<string>"
PROBE = "func_id long, function_name string, hash string, bucket string, entropy double, blocks int, loops int, calls array<string>, literals array<string>, obf_score double, obf_class string, indirect double"


def probe(i, h, b, e=5.0):
    return (i, f"f{i}", h, b, e, 10, 1, ["net.Dial"], ["HELLO world"], None, None, None)


def sig(i, h, b, e=5.0, tol=0.5, req=("net.Dial",), pat=("hello",)):
    return (i, i, "HIGH", h, b, e, tol, 10, 1, list(req), list(pat))


@pytest.fixture(scope="module")
def tables(spark):
    p = spark.createDataFrame([probe(1, "h1", "b1"), probe(2, "h2", "b1"), probe(3, "h3", "")], PROBE)
    s = spark.createDataFrame([sig("A", "h1", "b1"), sig("B", "h9", "b1", 5.2), sig("C", "h2", "", 9.0, 0.1), sig("D", "h1", "b1", 5.0, 0.0), sig("E", "x", "")], SIG)
    return p, s


def pairs(df):
    return sorted((r["func_id"], r["s_id"]) for r in df.select("func_id", "s_id").collect())


def test_candidates_have_no_duplicates_and_respect_the_band(tables):
    assert pairs(scan.candidates(*tables)) == [(1, "A"), (1, "B"), (1, "D"), (2, "A"), (2, "B"), (2, "D")]


def test_cells_of_entropy_lose_and_repeat_no_pair(spark):
    nan = float("nan")
    values = [0.0, 0.49, 0.5, 2.25, 7.99, 8.0, 9.5, -1.0, nan, None]
    p = spark.createDataFrame([probe(k, "h", "b", e) for k, e in enumerate(values)], PROBE)
    bands = [(e, tol) for e in (0.0, 0.5, 4.0, 8.0, 9.0, nan, None) for tol in (0.0, 0.1, 0.5, 3.0, 20.0, nan, None)]
    s = spark.createDataFrame([sig(f"s{k}", "x", "b", e, tol) for k, (e, tol) in enumerate(bands)], SIG)
    got = scan.candidates(p, s).select("func_id", "s_id").collect()
    j = p.crossJoin(s.select(F.col("id").alias("s_id"), F.col("entropy_score").alias("se"), F.col("entropy_tolerance").alias("st")))
    want = j.where(F.abs(F.col("entropy") - F.col("se")) <= F.when(F.coalesce("st", F.lit(0.0)) == 0, 0.5).otherwise(F.col("st"))).select("func_id", "s_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_exact_takes_the_best_and_least_id(tables):
    assert pairs(scan.scan_exact(*tables)) == [(1, "A")]


def test_full_scan_has_no_band(tables):
    p, s = tables
    got = pairs(scan.scan_full(p, s, 0.5))
    assert (2, "C") in got and len(got) == 15


def test_unset_band_with_equal_entropy_never_matches_exactly(tables):
    p, s = tables
    got = scan.scan_full_exact(p, s.withColumn("pos", F.monotonically_increasing_id()).where("id in ('D')"), "pos")
    assert got.count() == 0  # 0/0


def test_empty_tables(tables, spark):
    p, s = tables
    assert scan.scan_bucket(p.limit(0), s).count() == 0
    assert scan.scan_bucket(p, s.limit(0)).count() == 0
    row = scan.severity_rollup(spark.createDataFrame([], "severity string")).first()
    assert row["total"] == 0


def test_closure_ends_on_cycles_and_stops_at_standard_packages(spark):
    e = spark.createDataFrame([("r/a", "x.y/b"), ("x.y/b", "x.y/c"), ("x.y/c", "x.y/b"), ("r/a", "fmt"), ("fmt", "z.z/q"), ("r/a", "r/own")], "pkg_path string, import_path string")
    roots = spark.createDataFrame([("r/a",)], "pkg_path string")
    assert sorted(r[0] for r in closure.dependencies(e, roots, "r/").collect()) == ["x.y/b", "x.y/c"]
    assert [r[0] for r in closure.dependencies(e, roots, "r/", transitive=False).collect()] == ["x.y/b"]
    assert closure.dependencies(e.limit(0), roots, "r/").count() == 0
    assert sorted(r[0] for r in closure.dependencies(e, roots, "").collect()) == ["x.y/b", "x.y/c"]


def test_dependency_filter(spark):
    cases = [("fmt", False), ("net/http", False), ("github.com/user/lib", True), ("gopkg.in/yaml.v2", True), ("myinternal/pkg", False), ("cloud.google.com/go", True)]
    df = spark.createDataFrame(cases, "p string, e boolean").select("e", closure.is_third_party(F.col("p"), F.lit(None).cast("string")).alias("k"))
    assert all(r.e == r.k for r in df.collect())


def test_assignment_is_one_to_one_and_stable(spark):
    rows = [("b", "o1", "n1", 0.9), ("b", "o1", "n2", 0.95), ("b", "o2", "n2", 0.99), ("b", "o2", "n1", 0.7), ("c", "o3", "n3", 0.6)]
    got = diff.assign(spark.createDataFrame(rows, "old_bucket string, old_function_name string, new_function_name string, similarity double"))
    assert sorted((r[1], r[2]) for r in got.collect()) == [("o1", "n1"), ("o2", "n2"), ("o3", "n3")]


def test_budget_skips_but_goes_on(spark):
    df = spark.createDataFrame([(["aaaa", "b" * 20, None, "cc"],)], "l array<string>").select(features.within_budget(F.col("l"), 10, 12).alias("k"))
    assert df.first()["k"] == ["aaaa", "cc"]  # the second would be 10 bytes and does not fit beside 4


def test_byte_runs(spark):
    i = spark.createDataFrame([(1, k, c) for k, c in enumerate([1, 2, None, 3, 999, 4])] + [(2, 0, 300)], "func_id long, pos long, const_int long")
    assert {r[0]: r[1] for r in features.longest_byte_run(i).collect()} == {1: 3, 2: 0}


def test_fingerprint_table_reports_errors_as_data(spark):
    f = spark.createDataFrame([(1, "f", ["int"], ["int"]), (2, "g", [], [])], "func_id long, function_name string, param_types array<string>, return_types array<string>")
    i = spark.createDataFrame([(1, "t0", 0, 0, "BinOp", "+", "int"), (1, "r", 0, 1, "Return", "", None), (2, "x", 0, 0, "Odd", "", None)], "func_id long, instr_id string, block_idx int, pos int, kind string, op string, value_type string")
    o = spark.createDataFrame([(1, "t0", 0, "x", "param", "0", None, None, "int"), (1, "t0", 1, "y", "const", "", "int", "5", "int"), (1, "r", 0, "result", "instr", "t0", None, None, "int")], "func_id long, instr_id string, slot int, slot_role string, ref_kind string, ref_id string, const_kind string, const_int string, value_type string")
    e = spark.createDataFrame([], "func_id long, src int, dst int, ord int")
    a = canonical.assemble(f, i, o, e)
    loose = {r["func_id"]: r for r in canonical.fingerprints(a).collect()}
    assert len(loose[1]["fingerprint"]) == 64 and "v0 = BinOp + const(5), p0" in loose[1]["canonical"]
    strict = {r["func_id"]: r for r in canonical.fingerprints(a, strict=True).collect()}
    assert strict[1]["error"] is None and "Odd" in strict[2]["error"]


def test_files(spark, tmp_path):
    for name in ("a.go", "a_test.go", "vendor/v.go", ".git/h.go", "sub/b.go", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("package x")
    found = files.list_files(spark, str(tmp_path))
    assert sorted(r[0] for r in found.where(files.is_source(F.col("path"))).select("path").collect()) == ["a.go", "sub/b.go"]
    assert files.total_size(found).first()["bytes"] == 9 * found.count()
    got = spark.range(1).select(files.name_status(F.lit("M\0a\0D\0b\0R90\0c\0d\0")).alias("x")).first()["x"]
    assert [tuple(x) for x in got] == [("M", "a", "a"), ("R90", "c", "d")]
    assert spark.range(1).select(F.size(files.name_status(F.lit(""))).alias("n")).first()["n"] == 0


def test_store_versions_upserts_and_refuses(spark, tmp_path):
    schema = store.signature_schema()
    row = lambda i, h: (i, "n", None, "HIGH", None, h, "B", 1.0, 0.5, 1, 0, None, None, None)
    batch = lambda *rows: spark.createDataFrame(list(rows), schema).withColumn("position", F.monotonically_increasing_id()).coalesce(1)
    s = store.Store(spark, str(tmp_path / "db"))
    s.initialise("2025-01-01")
    assert s.add(batch(row("DUP", "T1"), row(None, "T9"))) == 0
    snapshot = s.read()
    assert s.add(batch(row("DUP", "T2"), row("DUP", "T3"))) == 1
    assert {(r["id"][:9], r["topology_hash"]) for r in s.read().collect()} == {("DUP", "T3"), ("SFW-AUTO-", "T9")}
    assert {r["topology_hash"] for r in snapshot.collect()} == {"T1", "T9"}
    with pytest.raises(ValueError):
        s.add(batch(row("X", "")))
    with pytest.raises(KeyError):
        s.remove(["nope"])
    s.remove(["DUP"])
    assert s.read().count() == 1
    with pytest.raises(KeyError):
        s.get("DUP")
    s.initialise("2026-01-01")
    assert s.metadata()["created_at"] == "2025-01-01"
    s.set_metadata(schema_version="2")
    with pytest.raises(ValueError):
        s.read()


def test_json_documents(spark, tmp_path):
    good = {"version": "1", "signatures": [{"id": "A", "topology_hash": "t", "identifying_features": {"required_calls": ["x"]}}, {"id": "A", "topology_hash": "u"}]}
    path = tmp_path / "db.json"
    path.write_text(json.dumps(good))
    df = store.read_json(spark, str(path))
    assert store.by_id(df, "A", "position").first()["topology_hash"] == "u"
    path.write_text(json.dumps(good | {"generated_at": "now"}))
    with pytest.raises(ValueError):
        store.read_json(spark, str(path))
    assert store.read_json(spark, str(path), strict=False).count() == 2
    path.write_text(json.dumps({"version": "1"}))
    with pytest.raises(ValueError):
        store.read_json(spark, str(path))
    s = store.Store(spark, str(tmp_path / "out"))
    path.write_text(json.dumps(good))
    s.add(store.read_json(spark, str(path)))
    s.export(str(tmp_path / "export"), "now")
    text = "".join(p.read_text() for p in sorted((tmp_path / "export").glob("part-*")))
    assert [x["id"] for x in json.loads(text)["signatures"]] == ["A"]


def test_config_is_checked():
    for bad in (float("nan"), float("inf"), -0.1, 1.1):
        with pytest.raises(ValueError):
            store.ScanConfig(threshold=bad)


def test_workspace(spark):
    df = workspace.materialize(spark.range(3), "t")
    assert df.count() == 3
    assert workspace.scratch_dir(spark) == workspace.scratch_dir(spark)


def test_diff_report_and_summary(spark):
    cols = "function_name string, param_count int, return_count int, block_count int, instr_count int, loop_count int, branch_count int, has_go boolean, call_signatures map<string,int>"
    missing = {c: "boolean" for c in ("has_defer", "has_recover", "has_panic", "has_select", "has_range")} | {"instr_counts": "map<string,int>", "binop_counts": "map<string,int>"}
    missing |= {c: "array<string>" for c in ("param_types", "return_types", "string_literals")} | {"entropy_score": "double", "obfuscation": "struct<score:double>"}

    def version(rows):
        return diff.version(spark.createDataFrame(rows, cols).withColumns({c: F.lit(None).cast(t) for c, t in missing.items()}))

    same, grown = ("p.Same", 1, 1, 4, 9, 0, 1, False, {"a.b": 1}), ("p.Grown", 1, 1, 4, 9, 0, 1, False, {"a.b": 1})
    old = version([same, grown, ("p.Before", 0, 0, 9, 30, 2, 3, False, {"x.y": 2}), ("p.Gone", 2, 0, 1, 3, 0, 0, False, {}), (None, 0, 0, 1, 1, 0, 0, False, {})])
    new = version([same, (*grown[:5], 1, 1, True, {"a.b": 1}), ("q.After", 0, 0, 9, 30, 2, 3, False, {"x.y": 2}), ("p.Fresh", 0, 3, 2, 5, 0, 0, False, {"n.d": 1})])
    rows = {r["function"]: r for r in diff.diff(old, new).collect()}
    assert {k: (r["status"], r["risk_score"]) for k, r in rows.items()} == {
        "Same": ("preserved", 0), "Grown": ("modified", 25), "Before → After": ("renamed", 0), "Gone": ("removed", 0), "Fresh": ("added", 10),
    }
    assert rows["Before → After"]["fingerprint_match"] and rows["Grown"]["topology_delta"] == "Loops+1, AddedGoroutine"
    s = diff.summary(diff.diff(old, new)).first()
    assert (s["total_functions"], s["preserved"], s["modified"], s["added"], s["removed"], s["renamed_functions"], s["high_risk_changes"]) == (5, 1, 2, 1, 1, 1, 2)
    assert (s["semantic_match_pct"], s["topology_matched_pct"]) == (20.0, 60.0)
    assert diff.summary(diff.diff(old.limit(0), new.limit(0))).first()["semantic_match_pct"] == 0.0


def test_every_pair_of_a_bucket_is_scored(spark, tmp_path):
    from topolith.plans import catalog

    cols = "func_id long, param_count int, return_count int, block_count int, instr_count int, loop_count int, branch_count int, has_defer boolean, has_recover boolean, has_panic boolean, has_go boolean, has_select boolean, has_range boolean"
    cols += ", call_signatures map<string,int>, instr_counts map<string,int>, binop_counts map<string,int>, param_types array<string>, return_types array<string>, string_literals array<string>, entropy_score double, obfuscation struct<score:double>"
    row = lambda i, blocks, calls, types: (i, 1, 0, blocks, 9, 0, 1, *[False] * 6, calls, {}, {}, types, [], [], 1.0, None)
    rows = [row(1, 4, {"a": 1}, ["int"]), row(2, 4, {"b": 1}, ["string"]), row(3, 5, {"a": 1}, ["int"]), row(4, 4, None, None), row(5, 64, {"a": 1}, ["int"])]
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "topology.parquet"))
    got = {tuple(r)[:2]: r[2] for r in catalog.QUERIES["map_similarity_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2): 0.0, (1, 3): 1.0, (1, 4): 0.0, (2, 3): 0.0, (2, 4): 0.0, (3, 4): 0.0}
    dice = {tuple(r)[:2]: r[2] for r in catalog.QUERIES["type_dice_pairs"](spark, str(tmp_path)).collect()}
    assert dice == {(1, 2): 0.0, (1, 3): 1.0, (1, 4): 0.0, (2, 3): 0.0, (2, 4): 0.0, (3, 4): 0.0}
    whole = [tuple(r) for r in catalog.QUERIES["topology_similarity_pairs"](spark, str(tmp_path)).collect()]
    assert len(whole) == 6 and {p[:2]: p[2] for p in whole}[(1, 3)] > 0.95


def test_full_scans_agree_with_the_score_of_every_pair(spark):
    """Pairs are compared by numbers; the outcome is that of scoring all of them, odd values included."""
    rng = random.Random(3)
    nan = float("nan")
    pick = lambda *x: rng.choice(x)
    some = lambda words: [rng.choice(words) for _ in range(rng.randint(0, 3))]
    calls, words = ("net.Dial", "os.Open", "invoke:os.OpenFile", "x"), ("Token=abc", "tmp", "ABC", "")
    p = [(k, pick("h1", "h2", None), "b", pick(0.0, 4.0, 4.25, nan, None), rng.randint(0, 4), rng.randint(0, 3), sorted(set(some(calls))), some(words), pick(None, 0.3, 0.9, 1.7), pick(None, "LOW", "HIGH"), pick(None, 0.2, 0.8)) for k in range(60)]
    s = [(f"s{k}", "n", "HIGH", pick("h1", "h2", None), "b", pick(0.0, 4.0, 4.5, nan, None), pick(0.0, 0.5, 1.0, None), pick(0, 2, 4, None), pick(0, 1, None), pick(None, some(("net", "os.Open", "Dial", ""))), pick(None, some(("token", "ABC", "tmp", "zz")))) for k in range(80)]
    p = spark.createDataFrame(p, "func_id long, hash string, bucket string, entropy double, blocks int, loops int, calls array<string>, literals array<string>, obf_score double, obf_class string, indirect double")
    s = spark.createDataFrame(s, "id string, name string, severity string, topology_hash string, fuzzy_hash string, entropy_score double, entropy_tolerance double, node_count int, loop_depth int, required_calls array<string>, string_patterns array<string>")
    for least, tolerance in ((0.75, 0.5), (0.99, 0.0)):
        scored = scan.score(scan.all_pairs(p, s), tolerance).where(scan.sure(F.col("confidence"), least))
        want = {(r["func_id"], r["s_id"]): r["confidence"] for r in scored.select("func_id", "s_id", "confidence").collect()}
        got = scan.confidences(p, s, least, tolerance, ("func_id",), ("id",)).collect()
        assert {(r["k_func_id"], r["a_id"]): r["confidence"] for r in got} == want and len(got) == len(want) > 0
        assert sorted((r["func_id"], r["s_id"]) for r in scan.pairs_reaching(p, s, least, tolerance).collect()) == sorted(want)
    assert scan.scan_full(p.limit(0), s).count() == scan.scan_full(p, s.limit(0)).count() == 0


def test_feature_row_from_facts_feeds_hash_and_scan(spark):
    from topolith.functions import scoring

    f = spark.createDataFrame([(1, "p.F", ["a/b.T"], ["error"]), (2, "p.G", [], None), (3, "p.NoBlocks", [], [])], "func_id long, function_name string, param_types array<string>, return_types array<string>")
    kinds = [
        (0, "Defer", None, "defer:p.d"), (0, "Call", None, "builtin:recover"), (0, "Go", None, "go:dynamic:func()"), (0, "UnOp", "!", None), (0, "Jump", None, None),
        (1, "Phi", None, None), (1, "IndexAddr", None, None), (1, "BinOp", "^", None), (1, "BinOp", "+", None), (1, "Call", None, "net.Dial"), (1, "If", None, None),
        (2, "Select", None, None), (2, "Range", None, None), (2, "Panic", None, None),
    ]
    rows = [(1, b, k, *x) for k, (b, *x) in enumerate(kinds)] + [(2, 0, 0, "Call", None, "builtin:recover"), (2, 0, 1, "Return", None, None)]
    i = spark.createDataFrame(rows, "func_id long, block long, pos long, kind string, op string, call_sig string")
    o = spark.createDataFrame([(1, 6, 1, "index", 7), (1, 7, 1, "y", 1), (1, 8, 1, "y", 2), (1, 9, 0, "arg", 999), (1, 9, 1, "arg", 3)], "func_id long, pos long, slot int, slot_role string, const_int long")
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 1, 2)], "func_id long, src long, dst long")
    lits = spark.createDataFrame([(1, 0, "zz"), (1, 1, "HELLO world")], "func_id long, ord int, lit string")
    out = features.feature_rows(f, i, o, e, lits)
    got = {r["func_id"]: r.asDict(True) for r in out.collect()}
    assert set(got) == {1, 2}
    a, b = got[1], got[2]
    assert [a[c] for c in ("param_count", "return_count", "block_count", "instr_count", "loop_count", "branch_count", "phi_count", "cyclomatic")] == [1, 1, 3, 14, 1, 1, 1, 2]
    assert all(a["has_" + c] for c in ("defer", "recover", "panic", "go", "select", "range")) and not any(b["has_" + c] for c in ("defer", "recover", "panic", "go", "select", "range"))
    assert a["unop_counts"] == {"!": 1} and a["binop_counts"] == {"^": 1, "+": 1} and a["instr_counts"]["*ssa.Call"] == 2 and b["binop_counts"] == {}
    assert a["call_signatures"] == {"defer:p.d": 1, "builtin:recover": 1, "go:dynamic:func()": 1, "net.Dial": 1} and a["string_literals"] == ["HELLO world", "zz"]
    p = a["obfuscation"]
    assert (p["byte_array_payload_bytes"], p["indirect_call_ratio"], p["decoder_loop_likelihood"], p["flattening_score"]) == (2, 0.25, 0.5, 0.0)
    assert round(p["const_pool_entropy"], 3) == 1.922  # bytes 1, 2, e7, 3, 3: the subscript is left out
    assert b["entropy_profile"] == {"overall": 0.0, "string_literal_entropy": 0.0, "classification": "LOW"}
    assert out.select(scoring.topology_hash(scoring.side())).distinct().count() == 2
    hits = scan.scan_exact(scan.probes(out), scan.index_functions(out))
    assert ("p.F", "SFW-IDX-000000000001") in {(r["function_name"], r["s_id"]) for r in hits.select("function_name", "s_id").collect()}
