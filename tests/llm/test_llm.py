import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topolith.llm import catalog, cooccur, distinctive, history, leakage, packing, records, setjoin, topn, truncation

# ---------------------------------------------------------------- records


def test_call_names(spark):
    cases = [
        ('t3 = net.Dial("tcp":string, t1)', "net.Dial"), ("t32=utf8.RuneCountInString()", "utf8.RuneCountInString"), ("go a.b.C()", "a.b.C"), ("t1 = defer os.Exit(1:int)", "os.Exit"), ("  io.Copy(t1)\t", "io.Copy"),
        ("t9 = len(t17)", None), ("t0 = invoke t1.Close(t14)", None), ("t41 = t3(t30)", None), ("jump 2", None), ("t55 = convert string <- []byte (t36)", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([([a], b) for a, b in cases], "ops array<string>, want string")
    for r in df.select("want", records.call_names(F.col("ops")).alias("got")).collect():
        assert r["got"] == ([r["want"]] if r["want"] else [])
    assert spark.range(1).select(records.call_names(F.lit(None).cast("array<string>")).alias("x")).first()["x"] == []


def test_repeated_deliveries_are_one_record(spark):
    rows = [(1, ["a.b()"], "x"), (1, ["a.b()"], "y"), (None, ["c.d()"], "z"), (None, None, "z")]
    got = records.added_op_records(spark.createDataFrame(rows, "diff_id long, added_ops array<string>, items string"))
    assert sorted(map(repr, ((r[0], r[1]) for r in got.collect()))) == sorted(map(repr, [(1, ["a.b"]), (None, ["c.d"]), (None, [])]))


# ---------------------------------------------------------------- p1


def baskets(spark, sets, field="f"):
    return spark.createDataFrame([(field, sorted(set(s))) for s in sets], "field string, items array<string>")


@pytest.mark.parametrize("block", [2, 256])
def test_cooccurrence_against_brute_force(spark, block):
    rng = random.Random(3)
    sets = [{rng.choice("abcdefghij") for _ in range(rng.randint(0, 8))} for _ in range(150)] + [set("abc")] * 60
    single, pair = Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    got = {(r["item_a"], r["item_b"]): r for r in cooccur.cooccurrence(baskets(spark, sets), block=block).collect()}
    assert {k: r["count_ab"] for k, r in got.items()} == dict(pair)
    for (a, b), r in got.items():
        assert (r["n"], r["count_a"], r["count_b"]) == (len(sets), single[a], single[b])
        assert r["pmi"] == pytest.approx(math.log(pair[a, b] * len(sets) / (single[a] * single[b])))
    cut = cooccur.cooccurrence(baskets(spark, sets), 40, 0.2, block)
    least = max(40, math.ceil(len(sets) * 0.2))
    assert {(r["item_a"], r["item_b"]) for r in cut.collect()} == {p for p, c in pair.items() if c >= least}


def test_cooccurrence_edge_cases(spark):
    assert cooccur.cooccurrence(baskets(spark, [])).count() == 0
    df = spark.createDataFrame([(None, ["a", "b"], 1), (None, None, 2), ("f", ["a", "b"], 3)], "field string, items array<string>, n long")
    got = {r["field"]: (r["n"], r["count_ab"]) for r in cooccur.cooccurrence(df).collect()}
    assert got == {None: (2, 1), "f": (1, 1)}
    with pytest.raises(ValueError):
        cooccur.cooccurrence(df, min_count=0)


# ---------------------------------------------------------------- p3


@pytest.mark.parametrize("salts", [1, 7])
def test_top_n(spark, salts):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice(["s%03d" % k for k in range(60)] + [None]), rng.choice([0.5, 0.7, 0.7, None, float("nan"), 0.9, -0.0, 0.0])) for _ in range(900)]
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), -9), s)
    want = defaultdict(list)
    for (g, i), s in best.items():
        want[g].append((-s, i))
    df = spark.createDataFrame(rows, "g string, i string, s double").withColumn("salt", F.lit(1)).withColumn("rank", F.lit("x"))
    got = {(r["g"], r["i"], r["rank"]) for r in topn.top_n(df, "g", "i", "s", 5, salts).collect()}
    assert got == {(g, i, k + 1) for g, xs in want.items() for k, (_, i) in enumerate(sorted(xs)[:5])}
    assert topn.top_n(df.limit(0), "g", "i", "s", 5).count() == 0


# ---------------------------------------------------------------- p4


@pytest.mark.parametrize("hot_limit", [50_000, 0])
def test_distinctiveness(spark, hot_limit):
    sets = {1: ["a", "b", "c"], 2: ["a", "b"], 3: ["a"], 4: [], 5: ["a", "d"], 6: ["d", "b"], 7: ["lone"]}
    df = spark.createDataFrame([("f", k, sorted(v)) for k, v in sets.items()] + [(None, 9, ["a", "z"]), (None, 10, ["a"]), ("f", 11, None)], "field string, record_key long, items array<string>").withColumn("df", F.lit(7))
    got = {(r["field"], r["record_key"], r["term"]): r for r in distinctive.distinctiveness(df, mu=10, hot_share=0.2, hot_limit=hot_limit).collect()}
    count = Counter(t for v in sets.values() for t in v)
    total = sum(count.values())
    assert set(got) == {("f", k, t) for k, v in sets.items() for t in v if count[t] >= 2} | {(None, 9, "a"), (None, 10, "a")}
    r = got["f", 1, "b"]
    pc = count["b"] / total
    pd = (1 + 10 * pc) / (3 + 10)
    assert r["df"] == 3 and r["n_terms"] == 3 and r["score"] == pytest.approx(pd * math.log(pd / pc))
    assert got["f", 1, "b"]["score"] > got["f", 1, "a"]["score"]
    best = {(r["record_key"], r["term"]) for r in distinctive.best_terms(distinctive.distinctiveness(df), 2).where("field = 'f'").collect()}
    assert best == {(5, "d"), (6, "d")}


@given(st.integers(1, 60), st.integers(1, 5000), st.integers(1, 4999), st.floats(0.1, 1000))
def test_score_falls_as_more_records_hold_the_term(size, df, more, mu):
    total = 20000

    def score(d):
        pc = d / total
        pd = (1 + mu * pc) / (size + mu)
        return pd * math.log(pd / pc)

    assert score(df) > score(df + more) or math.isclose(score(df), score(df + more), rel_tol=1e-9)


# ---------------------------------------------------------------- p5


def sets_table(spark, sets, start=1):
    return spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets, start)], "row_id long, tokens array<string>")


def kin(n, seed=0):
    rng = random.Random(seed)
    sets = []
    for _ in range(n):
        base = {f"v{rng.randint(0, 4000)}" for _ in range(rng.randint(3, 20))}
        sets.append(base)
        for _ in range(rng.randint(0, 3)):
            out = set(base)
            for _ in range(rng.randint(0, 4)):
                out.discard(rng.choice(sorted(base)))
                out.add(f"v{rng.randint(0, 4000)}")
            sets.append(out)
    return sets


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def test_similar_rows_against_brute_force(spark):
    sets = kin(400) + [set("abcdef")] * 12 + [set("abc")] * 3
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets, 1), 2) if min(len(a), len(b)) >= 4 and jaccard(a, b) >= 0.7 - 1e-9}
    got = [(r[0], r[1]) for r in setjoin.similar_rows(sets_table(spark, sets)).collect()]
    assert len(got) == len(set(got))
    assert set(got) <= want and len(got) >= 0.99 * len(want)
    links = {r["row_id"]: r["links"] for r in setjoin.similar_counts(sets_table(spark, sets)).collect()}
    count = Counter(x for p in got for x in p)
    assert links == {k: count[k] for k, s in enumerate(sets, 1) if len(s) >= 4}


def test_similar_rows_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (None, ["a", "b", "c", "d"]), (2, []), (3, ["a", "b", "c", "d"])], "row_id long, tokens array<string>").withColumn("size", F.lit(1))
    assert setjoin.similar_rows(df).count() == 0
    assert setjoin.similar_rows(df.limit(0)).count() == 0
    long = sets_table(spark, [{f"x{k}" for k in range(3000)}, {f"x{k}" for k in range(2500)}])
    assert [tuple(r) for r in setjoin.similar_rows(long).collect()] == [(1, 2)]


@pytest.mark.parametrize("classes", [10, 20_000, 10**6])
def test_plan_is_calibrated(classes):
    p = setjoin.plan(0.7, classes)
    assert p.recall > 0.997 and p.width == min(24, max(12, math.ceil(math.log2(classes))))
    rng = np.random.default_rng(1)
    bits = p.words * 64
    hits = 0
    for _ in range(800):
        agree = rng.random(bits) < 0.85
        hits += agree[: p.segments * p.width].reshape(-1, p.width).all(axis=1).any() and (~agree[: p.check_words * 64]).sum() <= p.radius
    assert hits >= 0.985 * 800
    assert setjoin.plan(1.0, classes).radius == 0


def test_hot_classes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HOT_CLASSES", 5)
    sets = [set("abcdef")] * 12 + [set("abcdeg")] * 9 + kin(60)
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets, 1), 2) if min(len(a), len(b)) >= 4 and jaccard(a, b) >= 0.7 - 1e-9}
    got = [tuple(r) for r in setjoin.similar_rows(sets_table(spark, sets)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# ---------------------------------------------------------------- p2


@given(st.sampled_from([(0.5, 4), (0.6, 5), (0.7, 4), (0.9, 20), (0.3, 4)]), st.integers(4, 60), st.integers(0, 10**9))
@settings(max_examples=400, deadline=None)
def test_winnowing_never_loses_a_similar_pair(kind, n, seed):
    threshold, least = kind
    rng = random.Random(seed)
    a = {rng.randint(0, 10**6) for _ in range(n)}
    b, keep = set(a), set(a)
    while b and len(a & b) / len(a | b) >= threshold:
        keep = set(b)
        b.discard(rng.choice(sorted(b)))
        if rng.random() < 0.5:
            b.add(rng.randint(0, 10**6))
    if min(len(a), len(keep)) < least:
        return
    run = history.run_length(threshold, least)

    def prints(s):
        xs = sorted(s)
        hashes = sorted(hash((tuple(xs[k : k + run]), 7)) for k in range(len(xs) - run + 1))
        shared = history.shared_runs(len(xs), threshold) if run == 2 else math.ceil(len(xs) * threshold - 1e-9)
        return set(hashes[: len(hashes) - shared + 1])

    assert prints(a) & prints(keep)


def test_fingerprints_are_winnowed_and_shared(spark):
    rng = random.Random(1)
    sets = []
    for _ in range(60):
        a = {f"v{rng.randint(0, 9999):04d}" for _ in range(rng.randint(8, 40))}
        sets += [sorted(a), sorted(set(sorted(a)[len(a) // 8 :]) | {f"v{rng.randint(0, 9999):04d}"})]
    df = spark.createDataFrame([(bytes([k]), 1, s) for k, s in enumerate(sets)], "g binary, salt long, tokens array<string>")
    prints = {r["g"][0]: set(r["fps"]) for r in df.select("g", history.fingerprints(0.7, 4).alias("fps")).collect()}
    assert all(prints[2 * k] & prints[2 * k + 1] for k in range(60) if jaccard(set(sets[2 * k]), set(sets[2 * k + 1])) >= 0.7)
    assert sum(map(len, prints.values())) < 0.75 * sum(len(s) - 1 for s in sets)
    topo = df.select("g", F.lit(None).cast("long").alias("salt"), F.lit(None).cast("array<string>").alias("tokens"))
    assert all(len(r[0]) == 1 for r in topo.select(history.fingerprints(0.7, 4)).collect())


ROW = "row_id long, batch_no int, id string, topology_hash string, fuzzy_hash string, identifying_features struct<required_calls:array<string>,optional_calls:array<string>,string_patterns:array<string>>"


def row(k, batch, id_, topo, fuzzy, calls):
    return (k, batch, id_, topo, fuzzy, (calls, None, None) if calls is not None else None)


def hexes(seed):
    return "%032x" % random.Random(seed).getrandbits(128)


def expected_repeats(sigs, feed):
    def key(r):
        t = (r[3] or "").lower().rsplit(":", 1)[-1].strip()
        ok = len(t) == 32 and len(set(t)) > 1 and all(c in "0123456789abcdef" for c in t)
        clean = lambda x: (x or "").strip().lower() or None
        return (t if ok else None, clean(r[4]), clean(r[2]), set(r[5][0]) if r[5] else set())

    accepted, out = [(r[0], key(r)) for r in sigs], set()
    for r in sorted(feed):
        k = key(r)
        hits = []
        for a, o in accepted:
            same_hash = k[0] is not None and k[0] == o[0]
            near = min(len(k[3]), len(o[3])) >= 4 and jaccard(k[3], o[3]) >= 0.7 - 1e-9
            named = (k[1] is not None and k[1] == o[1]) or (k[2] is not None and k[2] == o[2])
            if same_hash or (near and named):
                hits.append(a)
        if hits:
            out.add((min(hits), r[0]))
        else:
            accepted.append((r[0], k))
    return out


def feed_rows(seed, n_sigs, n_feed, per_batch=12):
    rng = random.Random(seed)
    pool = kin(25, 2)

    def some(k, batch):
        return row(
            k, batch, rng.choice([None, "", "id1", " ID1 ", "id2", f"u{k}"]), rng.choice([None, "", "N/A", "0" * 32, hexes(rng.randint(0, 12)), "sha256: " + hexes(rng.randint(0, 12)).upper() + " "]),
            rng.choice(["B1", "b1 ", "B2", None, ""]), rng.choice([None, *map(sorted, pool)]),
        )

    return [some(k, None) for k in range(1, n_sigs + 1)], [some(100 + k, 1 + k // per_batch) for k in range(n_feed)]


def test_repeats_against_sequential_brute_force(spark):
    sigs, feed = feed_rows(5, 40, 60)
    s, f = spark.createDataFrame(sigs, ROW).drop("batch_no"), spark.createDataFrame(feed, ROW)
    got = [(r[0], r[1]) for r in history.repeats(s, f).collect()]
    assert len(got) == len(set(got)) and set(got) == expected_repeats(sigs, feed)


@pytest.mark.parametrize("local", [history.LOCAL, 0])
def test_a_reopened_index_goes_on_where_it_stopped(spark, tmp_path, local):
    sigs, feed = feed_rows(11, 30, 48, 16)
    want = expected_repeats(sigs, feed)
    path = str(tmp_path / "index")
    first = history.HistoryIndex(spark, path, 100)
    first.load(spark.createDataFrame(sigs, ROW))
    got = set()
    for n in (1, 2, 3):
        index = history.HistoryIndex(spark, path)  # every batch opens the index anew
        assert index.state["prints"] > 0
        batch = spark.createDataFrame([r for r in feed if r[1] == n], ROW).withColumn("g", F.lit("x"))
        got |= {(r[0], r[1]) for r in index.ingest(batch, local).collect()}
    assert got == want
    again = history.HistoryIndex(spark, path).ingest(spark.createDataFrame([r for r in feed if r[1] == 3], ROW), local).count()
    with_groups = [r for r in feed if r[1] == 3 and (r[5] and len(set(r[5][0])) >= 4 and ((r[2] or "").strip() or (r[4] or "").strip()) or (r[3] or "").rsplit(":", 1)[-1].strip().strip("0") not in ("", "N/A"))]
    assert again == len(with_groups)  # everything with a group is held by now
    with pytest.raises(ValueError):
        history.HistoryIndex(spark, path, threshold=0.8)
    with pytest.raises(ValueError):
        history.HistoryIndex(spark, path).load(spark.createDataFrame(sigs, ROW))


def test_rows_read_for_a_batch_do_not_grow_with_the_history(spark, tmp_path):
    def content(k):
        rng = random.Random(k)
        return row(k, 1, f"i{k}", hexes(k), f"F{k}", [f"v{rng.randint(0, 10**6)}" for _ in range(6)])

    read = []
    for n in (2000, 8000):
        index = history.HistoryIndex(spark, str(tmp_path / f"n{n}"), n, per_filter=500)
        index.load(spark.createDataFrame([content(k) for k in range(n)], ROW))
        batch = [content(3), (10**7, 1, *content(5)[2:]), *[content(10**8 + k) for k in range(20)]]
        assert {tuple(r) for r in index.ingest(spark.createDataFrame([(10**7 + 1, *content(3)[1:]), *batch[1:]], ROW)).collect()} == {(3, 10**7 + 1), (5, 10**7)}
        read.append(index.store(index.looked_up).count())
        assert len(index.looked_up) < 0.6 * index.state["parts"]
    assert read[1] < 1.3 * read[0]


def shuffled_records(spark):
    """Records that all stages so far have written to shuffles."""
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    no_numbers = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, no_numbers, None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def test_the_history_is_not_moved_for_a_batch_too_large_to_send(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "SENT", 0)

    def content(k):
        rng = random.Random(k)
        return row(k, 1, f"i{k}", hexes(k), f"F{k}", [f"v{rng.randint(0, 10**6)}" for _ in range(6)])

    index = history.HistoryIndex(spark, str(tmp_path / "i"), 6000)
    index.load(spark.createDataFrame([content(k) for k in range(6000)], ROW))
    batch = spark.createDataFrame([(10**7 + k, *content(50 * k)[1:]) for k in range(100)] + [content(10**8 + k) for k in range(20)], ROW)
    sizes = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in sizes:  # at this size Spark would send one side by itself
            spark.conf.set(name, "-1")
        held, before = index.store().count(), shuffled_records(spark)
        assert {tuple(r) for r in index.ingest(batch).collect()} == {(50 * k, 10**7 + k) for k in range(100)}
        moved = sum(n for k, n in shuffled_records(spark).items() if k not in before)
    finally:
        for name in sizes:
            spark.conf.unset(name)
    assert moved < 0.5 * held, (moved, held)


def test_rows_among_keys_are_found_where_they_lie(spark):
    keys, rows = spark.range(1000).select(F.xxhash64("id").alias("fp")), spark.range(100_000).select("id", F.xxhash64("id").alias("fp"))
    got = [r[0] for r in history.among(rows, keys, 1000).select("id").collect()]
    assert {k for k in got if k < 1000} == set(range(1000)) and len(got) == len(set(got)) < 4000


@pytest.mark.parametrize("sent", [history.SENT, 0])
def test_a_batch_takes_few_stages(spark, tmp_path, monkeypatch, sent):
    """The driver's memory grows with the stages it keeps."""
    monkeypatch.setattr(history, "SENT", sent)
    sigs, feed = feed_rows(7, 60, 48, 12)
    before = shuffled_records(spark)
    got = {(r[0], r[1]) for r in history.repeats(spark.createDataFrame(sigs, ROW).drop("batch_no"), spark.createDataFrame(feed, ROW)).collect()}
    assert got == expected_repeats(sigs, feed)
    if sent:
        assert len(set(shuffled_records(spark)) - set(before)) < 165


def test_segments_merge_and_partitions_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "MERGE", 2)
    index = history.HistoryIndex(spark, str(tmp_path / "i"), 1, per_filter=20)
    sets = [[f"a{k}b{j}" for j in range(8)] for k in range(40)]
    for n in range(4):
        batch = [row(k, n, f"i{k}", None, f"F{k}", sets[k]) for k in range(10 * n, 10 * n + 10)]
        assert index.ingest(spark.createDataFrame(batch, ROW)).count() == 0
    assert len(index.state["segments"]) <= 2 and index.state["parts"] > 4
    again = [row(1000 + k, 9, f"i{k}", None, f"F{k}", sets[k][1:] + ["z"]) for k in range(40)]
    assert {tuple(r) for r in history.HistoryIndex(spark, index.path).ingest(spark.createDataFrame(again, ROW)).collect()} == {(k, 1000 + k) for k in range(40)}


def test_repeats_of_empty_tables_and_chains(spark):
    none = spark.createDataFrame([], ROW)
    assert history.repeats(none.drop("batch_no"), none).count() == 0
    # b repeats a; c resembles b but not a, and b was not accepted, so c is new.
    base = [f"c{k}" for k in range(10)]
    b, c = base[1:] + ["x"], base[3:] + ["x", "y", "z"]
    feed = [row(1, 1, "i", None, "F", base), row(2, 1, "i", None, "F", b), row(3, 1, "i", None, "F", c), row(2**60 + 1, 1, "I ", None, "F", c), row(None, 1, "i", None, "F", c)]
    got = history.repeats(none.drop("batch_no"), spark.createDataFrame(feed, ROW)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2), (3, 2**60 + 1)]


def test_bloom_filters_have_no_false_negatives(spark):
    prints = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("part"), F.xxhash64("id").alias("fp"))
    filters = history.bloom_filters(prints.where("id % 2 = 0"), spark.createDataFrame([], history.FILTERS))
    filters = history.bloom_filters(prints.where("id % 2 = 1"), filters)
    assert filters.count() == 4
    assert history.bloom_positives(prints.select("part", "fp"), filters).count() == 5000
    other = spark.range(10**6, 10**6 + 5000).select(F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("part"), F.xxhash64("id").alias("fp"))
    assert history.bloom_positives(other, filters).count() < 100


# ---------------------------------------------------------------- p6


@given(st.lists(st.integers(1, 64), max_size=150), st.integers(64, 100))
@settings(deadline=None)
def test_best_two_fit_is_a_packing(sizes, capacity):
    bins = packing.best_two_fit(np.array(sizes, dtype=np.int64), capacity)
    used = Counter()
    for b, s in zip(bins, sizes):
        assert b >= 0
        used[b] += s
    assert all(v <= capacity for v in used.values())
    if sizes:
        assert len(used) <= 1.25 * math.ceil(sum(sizes) / capacity) + len([s for s in sizes if s > capacity / 2]) + 1


def test_two_smaller_items_replace_one():
    # Greedy takes 6 and 3 of ten; 2 + 2 fill the gap of 4 exactly.
    bins = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_packing_keeps_every_token(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([0, None, 1, 7, 30, 100, 101, 257, 1000])) for k in range(400)]
    sized = spark.createDataFrame(rows, "doc_id long, n_tokens int").withColumn("piece", F.lit("x"))
    out = packing.pack(sized, [("a", 100), ("b", 256)], shard_rows=50).collect()
    for kind, cap in (("a", 100), ("b", 256)):
        mine = [r for r in out if r["container_kind"] == kind]
        used = Counter()
        docs = defaultdict(list)
        for r in mine:
            used[r["container_id"]] += r["n_tokens"]
            docs[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
        assert max(used.values()) <= cap
        for k, n in rows:
            got = sorted(docs.get(k, []))
            assert sum(x for _, x in got) == (n or 0)
            assert len(got) <= 1 or n > cap
            assert all(a + x == b for (a, x), (b, _) in itertools.pairwise(got))
    fill = {r["container_kind"]: r["fill"] for r in packing.fill_report(packing.pack(sized, [("a", 100)])).collect()}
    assert fill["a"] > 0.95
    assert packing.pack(sized.limit(0), [("a", 100)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(sized, [("a", 0)])


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, " \n\t "), (4, "a" * 100_000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r[0]: r[1] for r in packing.token_counts(df).collect()}
    assert set(got) == {1, 4, 5} and got[1] == 2 and got[4] > 5000 and got[5] > 1


# ---------------------------------------------------------------- p7


def test_words():
    assert leakage.words_of("Ab_c­9​ xﬁne Ａ²!") == ["ab", "c9", "xfine", "a2"]
    assert leakage.words_of(None) == leakage.words_of(" \n") == []


def test_leakage_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, [rng.choice(vocab) for _ in range(rng.choice([5, 12, 13, 40, 90]))]) for k in range(40)]
    docs = []
    for k in range(300):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 12, 20, 37, 200, 900]))]
        if rng.random() < 0.6:
            item = rng.choice(items)[1]
            n = rng.choice([5, 11, 12, 13, 30])
            start = rng.randint(0, max(0, len(item) - n))
            at = rng.randint(0, len(words))
            words[at:at] = item[start : start + n]
        docs.append((k, words))
    grams = defaultdict(set)
    for k, w in items:
        for i in range(len(w) - 11):
            grams[tuple(w[i : i + 12])].add(k)
    want = {(d, k) for d, w in docs for i in range(len(w) - 11) for k in grams.get(tuple(w[i : i + 12]), ())}
    noise = lambda ws: "".join((w.upper() if rng.random() < 0.3 else w) + rng.choice([" ", ", ", "\n\n", " -- "]) for w in ws)
    d = spark.createDataFrame([(k, noise(w)) for k, w in docs] + [(999, None), (1000, "")], "doc_id long, text string").withColumn("item_id", F.lit(1))
    t = spark.createDataFrame([(k, noise(w)) for k, w in items] + [(77, None), (0, noise(items[0][1]))], "item_id long, text string")
    assert len(want) > 50
    rows = [(r[0], r[1]) for r in leakage.leaked(d, t).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    monkeypatch.setattr(leakage, "bitmap_bits", lambda keys: 1 << 16)  # a crowded bitmap loses nothing
    assert {(r[0], r[1]) for r in leakage.leaked(d, t).collect()} == want
    assert leakage.leaked(d, t.limit(0)).count() == 0
    assert leakage.leaked(d.limit(0), t).count() == 0


def test_runs_of_repeated_words_are_found(spark):
    t = spark.createDataFrame([(1, "0 1 " * 10), (2, "no " * 14), (3, "a b c " * 6)], "item_id long, text string")
    rng = random.Random(3)
    filler = lambda n: [f"w{rng.randint(0, 999)}" for _ in range(n)]
    docs = [(k, " ".join(filler(rng.randint(0, 60)) + ["0 1 " * 6, "no " * 12, "a b c " * 4][k % 3].split() + filler(rng.randint(0, 60)))) for k in range(300)]
    got = {tuple(r) for r in leakage.leaked(spark.createDataFrame(docs, "doc_id long, text string"), t).collect()}
    assert got == {(k, k % 3 + 1) for k in range(300)}


# ---------------------------------------------------------------- p8


def sentences(rng, n):
    subject, verb, thing, end = ["the parser", "my loop", "a reader", "that queue"], ["drops", "copies", "keeps", "reads"], ["the last row", "a header", "every value", "its lock"], ["on every call", "after a restart", "under load", "for no reason"]
    return " ".join(f"{rng.choice(subject)} {rng.choice(verb)} {rng.choice(thing)} {rng.choice(end)}.".capitalize() for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    rows, cut = [], set()
    for k in range(3000):
        source = rng.choice(["chars", "bytes", "clean"])
        t = sentences(rng, rng.randint(1, 14)).replace("loop", "lóóp")
        if source == "chars" and len(t) > 300:
            t = t[:300]
            if t[-1] != ".":
                cut.add(k)
        if source == "bytes" and len(t.encode()) > 400:
            t = t.encode()[:400].decode("utf-8", "ignore")
            if t[-1] != ".":
                cut.add(k)
        rows.append((k, source, t))
    return rows, cut


def test_limits_are_found(spark, texts):
    rows, _ = texts
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {(r["source"], r["unit"], r["len"]) for r in truncation.find_limits(truncation.measured(df)).collect()}
    assert ("chars", "chars", 300) in found and ("bytes", "bytes", 400) in found
    assert not any(s == "clean" for s, _, _ in found)


def test_truncated_texts_are_found(spark, texts):
    rows, cut = texts
    df = spark.createDataFrame([*rows, (9001, "chars", None), (9002, None, "  "), (9003, None, "One whole text here on every call.")], "doc_id long, source string, text string").withColumn("share", F.lit(1))
    out = truncation.truncated(df, sample_rows=1200)
    got = {r["doc_id"] for r in out.collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.03 * len(cut)
    share = {r["source"]: r["share"] for r in truncation.truncation_by_source(df, out).collect()}
    assert share["clean"] < 0.02 < share["chars"]


def test_hazards_keep_quiet_without_limits(spark):
    rng = random.Random(2)
    lens = Counter(min(3000, int(rng.expovariate(1 / 400)) + 5) for _ in range(20000) if True)
    lens.pop(3000, None)
    df = spark.createDataFrame([("s", "chars", k, v) for k, v in lens.items()], "source string, unit string, len int, n long")
    assert truncation.significant_lengths(truncation.length_hazards(df)).count() == 0
    assert truncation.significant_lengths(truncation.length_hazards(df.limit(0))).count() == 0


def test_words_and_breaks_are_counted(spark):
    keys, stopped = truncation.keys_of("One two. Three 12 four_5", {})
    assert Counter(keys) == Counter(["one", "two", "three", "0", " one", "one two", " three", "three 0"])
    assert sorted(stopped) == ["one two", "two"]
    assert truncation.keys_of("", {}) == truncation.keys_of("word", {}) == ([], [])
    df = spark.createDataFrame([("a b c. d",)] * 4 + [(None,)], "text string").where("text is not null")
    lex = truncation.lexicon(df)
    assert lex.word["a b"] == 4 and lex.brk["c"] == 4 and "d" not in lex.word


def test_scores_are_calibrated_by_unlabelled_texts():
    rng = np.random.default_rng(3)
    cut, whole = rng.normal(4, 1.5, 4000), rng.normal(-4, 1.5, 98_000)
    mixed = np.concatenate([whole, rng.normal(4, 1.5, 2000)])
    seen = np.bincount(np.clip(np.round(mixed * 4), -80, 80).astype(int) + 80, minlength=161)
    odds = truncation.calibrated(seen, cut)
    assert (np.diff(odds) >= -1e-9).all() and odds[80 - 12] < -2 and odds[80 + 16] > 6 and abs(odds[80]) < 2


def test_the_share_of_cut_texts_is_estimated(spark):
    rows = [("a", 5.0)] * 30 + [("a", -5.0)] * 70 + [("b", -5.0)] * 50 + [("c", 5.0)] * 3
    df = spark.createDataFrame(rows, "source string, ending double")
    got = {r["source"]: r["cut_share"] for r in truncation.cut_share(df, "source").collect()}
    assert abs(got["a"] - 0.3) < 0.02 and got["b"] == 0 and got["c"] > 0.99


def test_truncation_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert truncation.truncated(df).count() == 0


# ---------------------------------------------------------------- catalog


def test_catalog_names():
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 7, 8)} <= set(catalog.QUERIES)
    assert any(q.startswith("p6_") for q in catalog.QUERIES)


def test_null_keys_are_records_of_their_own(spark):
    from topolith.llm import distinctive

    rows = [("f", None, ["a", "x"]), ("f", None, ["b", "y", "z"]), ("f", 1, ["a", "b", "x", "y", "z"])]
    df = spark.createDataFrame(rows, "field string, record_key long, items array<string>")
    best = distinctive.best_terms(distinctive.distinctiveness(df), 2).where("record_key is null").collect()
    assert {r["term"] for r in best} == {"a", "x", "b", "y", "z"}
