import random

import pytest
from pyspark.sql import functions as F

from topolith.operators import diff, programs, report
from topolith.sources import facts, store


def table(spark, name, rows, columns):
    return facts.conform(spark.createDataFrame(rows, columns), name)


@pytest.fixture(scope="module")
def program(spark):
    f = table(spark, "functions", [(1, "p.F", None, False, ["int"], ["int"], "a.go"), (2, "p.gen", None, True, [], [], "a.go"), (3, "p.gen$1", 2, False, [], [], "a.go"), (4, "p.init", None, True, [], [], "b.go"), (5, "p.Decl", None, False, [], [], "a.go"), (6, "p.gen$1$1", 3, False, [], [], "a.go")],
              "func_id long, function_name string, parent_func_id long, is_synthetic boolean, param_types array<string>, return_types array<string>, file string")

    def body(op, callee):
        return [(1, 0, 0, "t0", "BinOp", op, "int", None, None), (1, 0, 1, "t1", "Call", "", "int", "static", callee), (1, 0, 2, "r", "Return", "", None, None, None)] + [(k, 0, 0, f"r{k}", "Return", "", None, None, None) for k in (2, 3, 4, 6)]

    instr = "func_id long, block_idx int, pos int, instr_id string, kind string, op string, value_type string, call_mode string, call_target string"
    operands = lambda callee: table(spark, "operands", [(1, "t0", 0, "x", "param", "0", None, None, None, "int"), (1, "t0", 1, "y", "const", "", "int", None, "5", "int"), (1, "t1", 0, "callee", "func", callee, None, None, None, "func"), (1, "t1", 1, "arg", "instr", "t0", None, None, None, "int"), (1, "t1", 2, "arg", "const", "", "string", "secret", None, "string"), (1, "r", 0, "result", "instr", "t1", None, None, None, "int")], "func_id long, instr_id string, slot int, slot_role string, ref_kind string, ref_id string, const_kind string, const_str string, const_int string, value_type string")
    edges = table(spark, "edges", [], "func_id long, src int, dst int, ord int")
    return lambda op="+", callee="net.Dial": facts.Facts(f, table(spark, "instrs", body(op, callee), instr), operands(callee), edges)


def test_visible_functions(program):
    assert sorted(r["func_id"] for r in facts.visible(program()).functions.collect()) == [1, 4]
    only = facts.visible(program(), F.col("file") == "b.go")
    assert [r["func_id"] for r in only.functions.collect()] == [4] and only.operands.count() == 0


def test_facts_are_read_with_declared_columns(spark, program, tmp_path):
    for name in facts.SCHEMAS:
        getattr(program(), name).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / f"{name}.parquet"))
    back = facts.read(spark, str(tmp_path))
    assert [getattr(back, n).columns for n in facts.SCHEMAS] == [[c.split()[0] for c in s.split(", ")] for s in facts.SCHEMAS.values()]
    names = [r["function_name"] for r in programs.fingerprints(back).collect()]
    assert names == ["p.F", "p.init"]


def test_programs_are_compared_by_instructions(program):
    row = {r["function"]: r for r in programs.compare(program(), program()).collect()}
    assert {k: r["status"] for k, r in row.items()} == {"F": "preserved", "init": "preserved"}
    new = {r["function"]: r for r in programs.compare(program(), program(callee="os.Open")).collect()}["F"]
    assert (new["status"], new["fingerprint_match"], new["matched_nodes"]) == ("modified", False, 1)
    assert len(new["added_ops"]) == len(new["removed_ops"]) == 2
    assert new["topology_delta"] == "NoStructuralChange" and new["risk_score"] == 0
    f = {r["function_name"]: r for r in programs.feature_rows(facts.visible(program())).collect()}["p.F"]
    assert f["call_signatures"] == {"net.Dial": 1} and f["string_literals"] == ["secret"] and f["binop_counts"] == {"+": 1}


def test_rounds_give_the_greedy_assignment(spark):
    rng = random.Random(2)
    rows = [("b" if k < 150 else "c", f"o{rng.randint(0, 14) + (20 if k >= 150 else 0)}", f"n{rng.randint(0, 14) + (20 if k >= 150 else 0)}", rng.choice([0.6, 0.7, 0.7, 0.9])) for k in range(200)]
    best = {}
    for b, o, n, s in rows:
        best[b, o, n] = max(best.get((b, o, n), 0), s)
    df = spark.createDataFrame([(*k, s) for k, s in best.items()], "old_bucket string, old_function_name string, new_function_name string, similarity double")
    one, many = (sorted(map(tuple, diff.assign(df, local).collect())) for local in (10**6, 10))
    assert one == many and len(one) > 20
    assert diff.assign(df.limit(0)).count() == 0


def test_store_refuses_a_second_writer_and_compacts(spark, tmp_path):
    schema = store.signature_schema()
    row = lambda i, h: (i, "n", None, "HIGH", None, h, "B", 1.0, 0.5, 1, 0, None, None, None)
    batch = lambda *rows: spark.createDataFrame(list(rows), schema).withColumn("position", F.lit(1).cast("long"))
    s = store.Store(spark, str(tmp_path / "db"))
    s.add(batch(row("A", "t")))
    late = s.version()
    s.add(batch(row("B", "u")))
    with pytest.raises(RuntimeError):
        s.write(batch(row("C", "v")), begun=late)
    assert sorted(r["id"] for r in s.read().collect()) == ["A", "B"]
    assert [r["id"] for r in s.read(0).collect()] == ["A"]
    assert s.compact() == 2 and s.read().count() == 2
    with pytest.raises(ValueError):
        s.read(0)
    doc = tmp_path / "db.json"
    doc.write_text('{"generated_at": "now", "signatures": [{"id": "A", "topology_hash": "w"}, {"id": "D", "topology_hash": "x"}, {"id": "D", "topology_hash": "y"}]}')
    assert s.migrate(str(doc)) == 3
    assert {r["id"]: r["topology_hash"] for r in s.read().collect()} == {"A": "w", "B": "u", "D": "y"}
    s.initialise("2025-01-01")
    s.set_all_metadata({"version": "9", "description": ""}, {"owner": "me"})
    s.touch("2025-02-02")
    m = s.all_metadata()
    assert (m["version"], m["description"], m["created_at"], m["last_updated_at"], m["signature_count"]) == ("9", None, "2025-01-01", "2025-02-02", 3)
    assert m["custom"] == {"owner": "me", "schema_version": store.SCHEMA_VERSION}
    s.set_metadata(owner=None)
    assert "owner" not in s.metadata()
    with pytest.raises(ValueError):
        s.set_all_metadata({"unknown": "x"}, {})


def test_where_a_store_is_looked_for(tmp_path, monkeypatch):
    monkeypatch.delenv(store.STORE_VARIABLE, raising=False)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / store.STORE_NAME).write_text("")
    folders = (str(tmp_path / "a"), str(tmp_path / "b"))
    assert store.resolve_path("x", folders) == "x"
    assert store.resolve_path("", folders) == str(tmp_path / "b" / store.STORE_NAME)
    assert store.resolve_path("", folders[:1]).endswith(store.STORE_NAME)
    monkeypatch.setenv(store.STORE_VARIABLE, "y")
    assert store.resolve_path("", folders) == "y"


def test_report_orders(spark):
    rows = spark.createDataFrame([("s2", "n", "f", 0.5), ("s1", "n", "f", 0.9), ("s3", "a", "f", None), ("s4", "z", "a", 0.9)], "signature_id string, signature_name string, matched_function string, confidence double")
    assert [r["signature_id"] for r in report.in_order(rows).collect()] == ["s4", "s3", "s1", "s2"]
    assert [r["signature_id"] for r in report.by_confidence(rows).collect()] == ["s1", "s4", "s2", "s3"]
