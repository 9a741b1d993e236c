import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topolith.functions import entropy, names, scoring, text


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return row.asDict()


# ---------------------------------------------------------------- entropy


@pytest.mark.parametrize("data, expected", [(b"", 0), (b"\0" * 4, 0), (b"\0\1\0\1", 1), (bytes(range(16)), 4), (b"abcdefghijklmnopqrstuvwxyz", 4.70044)])
def test_entropy(data, expected):
    assert entropy.entropy_of(data) == pytest.approx(expected, abs=1e-4)


def test_window_entropy_finds_a_packed_blob():
    data = b"\0" * 1920 + bytes(range(256)) + b"\0" * 1920
    assert entropy.window_entropy_of(b"\0" * 100) == 0
    assert entropy.window_entropy_of(data) >= 7.9
    assert entropy.entropy_of(data) <= 1.5


@given(st.binary(max_size=2000))
def test_entropy_bounds(data):
    assert 0 <= entropy.entropy_of(data) <= entropy.window_entropy_of(data) + 8
    assert 0 <= entropy.window_entropy_of(data) <= 8


def test_classes(spark):
    got = one(spark, **{f"e{i}": entropy.entropy_class(F.lit(float(v))) for i, v in enumerate((0, 4, 7, 8))})
    assert list(got.values()) == ["LOW", "NORMAL", "HIGH", "PACKED"]
    got = one(spark, **{f"o{i}": scoring.obfuscation_class(F.lit(v)) for i, v in enumerate((0.0, 0.24, 0.25, 0.49, 0.5, 0.74, 0.75, 1.0))})
    assert list(got.values()) == ["NONE", "NONE", "LOW", "LOW", "MODERATE", "MODERATE", "HIGH", "HIGH"]


def test_little_endian_and_prefix(spark):
    got = one(
        spark, small=entropy.little_endian_hex(F.lit(200)), wide=entropy.little_endian_hex(F.lit(0x010203)), zero=entropy.little_endian_hex(F.lit(0)), negative=entropy.little_endian_hex(F.lit(-2)),
        cut=entropy.utf8_prefix(F.lit("aéé"), 4), whole=entropy.utf8_prefix(F.lit("aé"), 9), none=entropy.utf8_prefix(F.lit("€"), 2),
    )
    assert got == {"small": "C8", "wide": "030201", "zero": "00", "negative": "FEFFFFFFFFFFFFFF", "cut": "aé", "whole": "aé", "none": ""}


# ---------------------------------------------------------------- names

WORD = st.from_regex(r"[a-z][a-z0-9]{0,5}", fullmatch=True)
PATH = st.lists(WORD, max_size=3).map(lambda xs: "".join(x + "/" for x in xs))


def composed(draw):
    """A full name with its display form and its join key, put together from parts by the rules."""
    path, pkg, kind, call, arg = draw(PATH), draw(WORD), draw(WORD).capitalize(), draw(WORD).capitalize(), draw(WORD).capitalize()
    other = draw(PATH) + draw(WORD)
    return draw(st.sampled_from([
        (f"{path}{pkg}.{call}", call, call),
        (f"{path}{pkg}.(*{kind}).{call}", f"(*{kind}).{call}", f"(*{kind}).{call}"),
        (f"(*{path}{pkg}.{kind}).{call}", f"(*{kind}).{call}", f"(*{kind}).{call}"),
        (f"{pkg}.{kind}.{call}", f"{kind}.{call}", call),
        (f"{path}{pkg}.{call}[{other}.{arg}]", f"{call}[{other}.{arg}]", f"{call}[{arg}]"),
        (f"{path}{pkg}.{call}[map[{other}.{arg}]int]", f"{call}[map[{other}.{arg}]int]", f"{call}[map[{arg}]int]"),
    ]))


@given(st.data())
def test_display_names_are_composed(data):
    full, shown, _ = composed(data.draw)
    assert names.display_text(full) == shown


def test_names(spark):
    rows = []

    @given(st.data())
    @settings(max_examples=150, database=None)
    def collect(data):
        rows.append(composed(data.draw))

    collect()
    df = spark.createDataFrame(rows, "full string, shown string, key string")
    got = df.select("full", "shown", "key", names.display_name(F.col("full")).alias("a"), names.join_name(F.col("full")).alias("b")).collect()
    assert [(r.full, r.a) for r in got] == [(r.full, r.shown) for r in got]
    assert [(r.full, r.b) for r in got] == [(r.full, r.key) for r in got]


@given(st.text(alphabet="ab./()[]*,", max_size=40))
def test_display_never_fails(s):
    assert isinstance(names.display_text(s), str)


def test_indirect(spark):
    """A prefix makes a call indirect, an invocation under go or defer excepted; of a package only the listed names do."""
    cases = [(p + "q.R", True) for p in names.INDIRECT_PREFIXES] + [(n, True) for n in names.INDIRECT_NAMES]
    cases += [(w + "invoke:q.R", False) for w in ("go:", "defer:")] + [(n + "Of", False) for n in names.INDIRECT_NAMES] + [("q.R", False), ("builtin:q", False), ("", False)]
    rows = spark.createDataFrame(cases, "s string, e boolean").select("s", "e", names.is_indirect(F.col("s")).alias("x")).collect()
    assert [(r.s, r.x) for r in rows] == cases


def test_labels(spark):
    got = one(
        spark, k=names.humanize_bytes(F.lit(1536)), m=names.humanize_bytes(F.lit(1 << 20)), b=names.humanize_bytes(F.lit(7)), s=names.suggest(F.lit("chek"), ["check", "diff"]), far=names.suggest(F.lit("zzzzzz"), ["check", "diff"]),
        f=names.fuzzy_hash(F.lit(8), F.lit(9), F.lit(1), F.lit(2), F.lit(0)), t=names.type_name(F.lit("*github.com/a/b.T")), mod=names.module_line(F.lit("// x\nmodule a.b/c\n")),
    )
    assert got == {"k": "1.5 KB", "m": "1.0 MB", "b": "7 B", "s": "check", "far": None, "f": "B3L5BR1P2R0", "t": "*b.T", "mod": "a.b/c"}


# ---------------------------------------------------------------- scoring


def test_topology_hash_golden(spark):
    side = scoring.empty_side() | {"block_count": F.lit(10), "loop_count": F.lit(1), "call_signatures": F.create_map(F.lit("net.Dial"), F.lit(1))}
    assert one(spark, h=scoring.topology_hash(side))["h"] == "af55823ac8c93d29e9811b38367d585b"


def test_similarity(spark):
    a = scoring.empty_side() | {"param_types": F.array(F.lit("int"))}
    b = scoring.empty_side() | {"param_types": F.array(F.lit("int"), F.lit("string"))}
    got = one(spark, same=scoring.topology_similarity(a, a), near=scoring.topology_similarity(a, b))
    assert got["same"] == pytest.approx(1)
    assert got["near"] == pytest.approx((15.5 - 1) / 15.5)


def _match(spark, **kw):
    d = {"same": F.lit(False), "like": F.lit(0.5), "dist": F.lit(0.0), "tol": F.lit(0.5), "default": 0.5, "req": [], "found": [], "pat": [], "hit": [], "obf": 0.0, "cls": "NONE", "ind": 0.0} | kw
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    c = scoring.match_score(d["same"], d["like"], d["dist"], d["tol"], d["default"], arr(d["req"]), arr(d["found"]), arr(d["pat"]), arr(d["hit"]), F.lit(d["obf"]), F.lit(d["cls"]), F.lit(d["ind"]))
    return one(spark, c=c)["c"]


def test_match_score_rules(spark):
    assert _match(spark, same=F.lit(True), req=["net.Dial"], found=["net.Dial"]) == pytest.approx(1)
    assert _match(spark, req=["missing.Call"]) == 0
    assert _match(spark, req=["missing.Call"], ind=0.8, cls="HIGH") > 0
    assert _match(spark, req=["missing.Call"], ind=0.5) > 0
    assert _match(spark, req=["missing.Call"], cls="MODERATE") > 0
    far = {"dist": F.lit(8.0), "tol": F.lit(0.1)}
    assert _match(spark, like=F.lit(0.2), obf=0.99, **far) == pytest.approx(0.35, abs=0.005)
    assert _match(spark, like=F.lit(0.32), obf=0.95, **far) == pytest.approx(0.475, abs=0.005)
    assert _match(spark, like=F.lit(0.32), obf=0.8, **far) == pytest.approx(0.41, abs=0.005)
    nan = _match(spark, same=F.lit(True), tol=F.lit(0.0), default=0.0)
    assert nan != nan


def test_trip_counts(spark):
    cases = [(0, 100, 1, "<", 100), (0, 10, 1, "<=", 11), (0, 10, 1, "!=", 10), (10, 0, 1, "<", 0), (0, 10, -1, "<", None), (5, 5, 1, "<=", 1), (5, 5, -1, ">=", 1), (5, 5, 1, "<", 0)]
    df = spark.createDataFrame(cases, "a long, b long, s long, o string, e long").select("e", scoring.trip_count(F.col("a"), F.col("b"), F.col("s"), F.col("o")).alias("t"))
    assert all(r.e == r.t for r in df.collect())


def test_risk_of_an_added_function(spark):
    new = scoring.empty_side() | {"loop_count": F.lit(1), "has_go": F.lit(True), "entropy_score": F.lit(2.9999), "call_signatures": F.create_map(F.lit("a"), F.lit(3))}
    d = one(spark, d=scoring.risk_delta(scoring.empty_side(), new))["d"]
    assert d["risk"] == 5 + 10 + 15 + 8
    assert d["label"] == "Calls+1, Loops+1, AddedGoroutine, Entropy+3.0"


# ---------------------------------------------------------------- text


def test_audit_text(spark):
    fenced = [("{\"a\":1}", "{\"a\":1}"), ("```json\n{\"a\":1}\n```", "{\"a\":1}"), ("Sure: {\"a\":1} done", "{\"a\":1}"), ("```\nnot json\n``` {\"a\":1}", "{\"a\":1}")]
    rows = spark.createDataFrame(fenced, "a string, b string").select("b", text.json_body(F.col("a")).alias("c")).collect()
    assert [r.c for r in rows] == [r.b for r in rows]
    got = one(
        spark, ok=text.output_fault(F.lit("match"), F.lit("fine\n")), v=text.output_fault(F.lit("x"), F.lit("")), c=text.output_fault(F.lit("LIE"), F.lit("a\x01")), p=text.output_fault(F.lit("LIE"), F.lit("IGNORE previous")),
        long=text.output_fault(F.lit("LIE"), F.lit("a" * 4001)), ops=text.listed_ops(F.array(*[F.lit(str(i)) for i in range(12)])), delay=text.retry_delay_ms(F.lit(9)),
    )
    assert got == {"ok": None, "v": "verdict", "c": "control", "p": "phrase:ignore previous", "long": "length", "ops": "0, 1, 2, 3, 4, 5, 6, 7, 8, 9 (+2 more)", "delay": 5000}


def test_nothing_imports_llm():
    root = os.path.join(os.path.dirname(__file__), "..", "topolith")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as source:
                    assert "llm" not in source.read(), f


def test_marks_reach_rows_without_metadata(spark):
    from topolith.sources import store

    rows = spark.createDataFrame([("a", None), ("b", ("x", None, ["r"])), ("c", ("y", None, None)), (None, None)], "id string, metadata struct<author:string,created:string,references:array<string>>")
    marks = spark.createDataFrame([("a", "n"), ("b", None)], "id string, notes string")
    got = {r["id"]: r["metadata"] for r in store.mark_false_positive(rows, marks, F.lit("2025-01-02").cast("timestamp")).collect()}
    assert got["a"]["references"] == ["FP:2025-01-02T00:00:00Z:n"] and got["a"]["author"] is None
    assert got["b"]["references"] == ["r", "FP:2025-01-02T00:00:00Z:"] and got["c"]["references"] is None and got[None] is None
