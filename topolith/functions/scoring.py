"""Hashes, similarities, scores and risk as column expressions.

A side is a mapping from the names of the feature row to columns, see ``side``.  Null counts are
0, null flags false, null lists and maps empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entropy import effective_tolerance

COUNTS = ("param_count", "return_count", "block_count", "instr_count", "loop_count", "branch_count")
FLAGS = ("has_defer", "has_recover", "has_panic", "has_go", "has_select", "has_range")
MAPS = ("call_signatures", "instr_counts", "binop_counts")
LISTS = ("param_types", "return_types", "string_literals")


def side(struct: str | None = None) -> dict[str, Column]:
    """Columns of a feature row, top-level or inside a struct column."""
    at = lambda c: F.col(f"{struct}.{c}" if struct else c)
    cols = {c: F.coalesce(at(c), F.lit(0)) for c in COUNTS}
    cols |= {c: F.coalesce(at(c), F.lit(False)) for c in FLAGS}
    cols |= {c: F.coalesce(at(c), F.create_map().cast("map<string,int>")) for c in MAPS}
    cols |= {c: F.coalesce(at(c), F.array().cast("array<string>")) for c in LISTS}
    return cols | {"entropy_score": F.coalesce(at("entropy_score"), F.lit(0.0)), "obfuscation": at("obfuscation")}


def mean(values: list[Column]) -> Column:
    """Mean of the non-null values; null if there is none."""
    kept = F.array_compact(F.array(*values))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


# ---------------------------------------------------------------- hashes


def call_entries(calls: Column) -> Column:
    """``length:name:count`` of a call histogram, sorted by code point; lengths are in bytes."""
    entry = lambda e: F.concat(F.octet_length(e["key"]), F.lit(":"), e["key"], F.lit(":"), F.coalesce(e["value"], F.lit(0)))
    return F.array_sort(F.transform(F.map_entries(calls), entry))


def hash_text(f: dict[str, Column]) -> Column:
    flag = lambda c, letter: F.when(f[c], letter).otherwise("")
    return F.concat(
        F.lit("P"), f["param_count"], F.lit("R"), f["return_count"], F.lit("B"), f["block_count"], F.lit("I"), f["instr_count"],
        F.lit("L"), f["loop_count"], F.lit("BR"), f["branch_count"], F.array_join(call_entries(f["call_signatures"]), ";"),
        flag("has_defer", "D"), flag("has_go", "G"), flag("has_select", "S"), flag("has_panic", "P"),
    )


def topology_hash(f: dict[str, Column]) -> Column:
    """First 16 bytes of the SHA-256 of the structure text, as 32 hex digits."""
    return F.substring(F.sha2(hash_text(f), 256), 1, 32)


# ---------------------------------------------------------------- similarity


def type_dice(a: Column, b: Column) -> Column:
    """Dice by position: twice the equal places over the sum of the lengths; 1 for two empty lists."""
    same = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"] == z["y"]))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * same / total)


def map_similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of two histograms; 1 if nothing is counted in either."""
    none = F.lit(0)
    pair = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, none).alias("x"), F.coalesce(y, none).alias("y"))))
    low = F.aggregate(pair, F.lit(0).cast("long"), lambda s, p: s + F.least(p["x"], p["y"]))
    high = F.aggregate(pair, F.lit(0).cast("long"), lambda s, p: s + F.greatest(p["x"], p["y"]))
    return F.when(high == 0, 1.0).otherwise(low / high)


def topology_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Similarity of two feature rows in [0, 1]."""
    gap = lambda c: F.abs(a[c] - b[c])
    most = lambda c: F.greatest(a[c], b[c])
    loops = F.when(gap("loop_count") == 0, 1.0).when(gap("loop_count") == 1, 0.5).otherwise(0.0)
    branches = F.when(most("branch_count") > 0, 1 - gap("branch_count") / most("branch_count")).otherwise(1.0)
    blocks = F.when(most("block_count") > 0, 1 - gap("block_count") / (2 * most("block_count"))).otherwise(1.0)
    same = [F.when(a[c] == b[c], 0.2).otherwise(0.0) for c in ("has_defer", "has_panic", "has_go", "has_select", "has_range")]
    # The weight of each part.
    parts = (
        (3.0, type_dice(a["param_types"], b["param_types"])),
        (2.0, type_dice(a["return_types"], b["return_types"])),
        (2.0, loops),
        (1.5, branches),
        (4.0, map_similarity(a["call_signatures"], b["call_signatures"])),
        (1.0, map_similarity(a["binop_counts"], b["binop_counts"])),
        (0.5, map_similarity(a["instr_counts"], b["instr_counts"])),
        (1.0, reduce(lambda x, y: x + y, same)),
        (0.5, blocks),
    )
    return reduce(lambda x, y: x + y, [w * c for w, c in parts]) / sum(w for w, _ in parts)


# ---------------------------------------------------------------- obfuscation


def clamp01(v: Column) -> Column:
    return F.when(F.isnan(v) | (v < 0), 0.0).when(v > 1, 1.0).otherwise(v)


def norm_cut(v: Column, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high``, a straight line between."""
    return F.lit(0.0) if high <= low else F.when(v <= low, 0.0).when(v >= high, 1.0).otherwise((v - low) / (high - low))


CLASSES = ("NONE", "LOW", "MODERATE", "HIGH")


def obfuscation_class(score: Column) -> Column:
    return F.when(score < 0.25, CLASSES[0]).when(score < 0.5, CLASSES[1]).when(score < 0.75, CLASSES[2]).otherwise(CLASSES[3])


def obfuscation_profile(
    window: Column, pool: Column, run: Column, indirect: Column, flattening: Column, decoder: Column,
    has_pool: Column, has_numbers: Column, has_calls: Column, many_blocks: Column, has_loop: Column,
) -> Column:
    """struct<score, class, indicators> from six signals.

    The weighted mean of the applicable signals, at least the strongest data signal, at least
    0.75 with a saturated window; below 0.5 unless a data signal or two structural ones fire.
    """
    # Label, value, weight, when it applies, whether it is a data signal.
    signals = (
        ("high-entropy-window", norm_cut(window, 5.0, 8.0), 0.30, has_pool, True),
        ("high-entropy-const-pool", norm_cut(pool, 4.0, 8.0), 0.20, has_numbers, True),
        ("byte-array-payload", norm_cut(run.cast("double"), 16.0, 256.0), 0.15, run > 0, True),
        ("indirect-dispatch", indirect, 0.15, has_calls, False),
        ("control-flow-flattening", flattening, 0.10, many_blocks, False),
        ("in-loop-decoder", decoder, 0.10, has_loop, False),
    )
    total = lambda terms: reduce(lambda x, y: x + y, terms)
    on = [F.coalesce(w, F.lit(False)) for _, _, _, w, _ in signals]
    weight = total([F.when(o, k).otherwise(0.0) for o, (_, _, k, _, _) in zip(on, signals)])
    value = total([F.when(o, v * k).otherwise(0.0) for o, (_, v, k, _, _) in zip(on, signals)])
    fired = [o & (v >= 0.5) for o, (_, v, _, _, _) in zip(on, signals)]
    count = lambda data: total([f.cast("int") for f, s in zip(fired, signals) if s[4] is data])
    strongest = F.greatest(*[F.when(o, v).otherwise(0.0) for o, (_, v, _, _, d) in zip(on, signals) if d])
    score = F.greatest(F.when(weight > 0, value / weight).otherwise(0.0), strongest, F.when(window >= 7.2, 0.75).otherwise(0.0))
    weak = (count(True) == 0) & (count(False) < 2)
    final = clamp01(F.when(weak, F.least(score, F.lit(0.49))).otherwise(score))
    labels = F.array_compact(F.array(*[F.when(f, s[0]) for f, s in zip(fired, signals)]))
    return F.struct(final.alias("score"), obfuscation_class(final).alias("class"), labels.alias("indicators"))


# ---------------------------------------------------------------- signatures


def signature_similarity(blocks: Column, loops: Column, node_count: Column, loop_depth: Column) -> Column:
    """Likeness of block and loop counts to a signature; 0.5 if the signature states neither."""
    fold = lambda x, y: F.when(x > y, y / x).otherwise(x / y)
    block = F.when(node_count > 0, F.when(blocks <= 0, 0.0).otherwise(fold(blocks.cast("double"), node_count)))
    loop = F.when(loop_depth > 0, F.when(loops <= 0, 0.0).otherwise(fold(loops.cast("double"), loop_depth)))
    return F.coalesce(mean([block, loop]), F.lit(0.5))


def calls_found(required: Column, calls: Column) -> Column:
    """Required calls that occur inside some call name (case matters)."""
    return F.filter(required, lambda r: F.exists(calls, lambda c: c.contains(r)))


def calls_missing(required: Column, calls: Column) -> Column:
    return F.filter(required, lambda r: ~F.exists(calls, lambda c: c.contains(r)))


def patterns_found(patterns: Column, literals: Column) -> Column:
    """Patterns that occur inside some literal, case aside."""
    low = F.transform(literals, lambda x: F.lower(x))
    return F.filter(patterns, lambda p: F.exists(low, lambda x: x.contains(F.lower(p))))


def string_patterns(literals: Column) -> Column:
    """Patterns of a signature: literals of three bytes or more, also without their quotes; sorted, distinct."""
    long = F.filter(literals, lambda x: x.isNotNull() & (F.octet_length(x) >= 3))
    bare = F.transform(long, lambda x: F.btrim(x, F.lit("\"'`")))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: F.octet_length(x) >= 3)))


def has_reconnect(calls: Column, loops: Column) -> Column:
    has = lambda part: F.exists(calls, lambda c: c.contains(part))
    return has("net.Dial") & has("time.Sleep") & (loops > 0)


def match_score(same_hash: Column, likeness: Column, distance: Column, tolerance: Column, default: float, required: Column, found: Column, patterns: Column, hits: Column, obf_score: Column, obf_class: Column, indirect: Column) -> Column:
    """Confidence that a function is what a signature describes.

    Mean of structure, entropy, call and string scores; 0 if a required call is missing although
    calls are mostly direct; a strongly obfuscated partial match is lifted to half the
    obfuscation score.  A band of 0 and a distance of 0 give NaN, never a match.
    """
    band = effective_tolerance(tolerance, default)
    structure = F.when(same_hash, 1.0).otherwise(likeness)
    inside = F.when(band == 0, F.lit(float("nan"))).otherwise(1 - distance / F.when(band != 0, band))
    entropy = F.when(distance <= band, inside).otherwise(0.5)
    call = F.when(F.size(required) > 0, F.size(found) / F.size(required))
    text = F.when((F.size(patterns) > 0) & (F.size(hits) > 0), F.size(hits) / F.size(patterns))
    average = mean([structure, entropy, call, text])
    score = F.coalesce(obf_score, F.lit(0.0))
    lifted = F.when((average >= 0.4) & ~F.isnan(average), F.greatest(average, 0.5 * score)).otherwise(average)
    plain = (F.coalesce(indirect, F.lit(0.0)) < 0.5) & F.coalesce(obf_class, F.lit("NONE")).isin(*CLASSES[:2])
    return F.when((F.size(found) < F.size(required)) & plain, 0.0).otherwise(lifted)


# ---------------------------------------------------------------- risk


def risk_delta(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """struct<label, risk, entropy_gain>: what a new version of a function added.

    Only additions count: distinct calls 5, loops 10, branches 2 each; first goroutine 15, defer 3,
    panic 5; entropy three times a gain above 1.
    """
    def step(name: str, gain: Column, weight: int) -> tuple[Column, Column]:
        sign = F.when(gain > 0, F.concat(F.lit(name + "+"), gain)).when(gain < 0, F.concat(F.lit(name), gain))
        return sign, F.greatest(gain, F.lit(0)) * weight

    def first(name: str, flag: str, weight: int) -> tuple[Column, Column]:
        came = new[flag] & ~old[flag]
        return F.when(came, name), F.when(came, weight).otherwise(0)

    calls = F.size(F.map_keys(new["call_signatures"])) - F.size(F.map_keys(old["call_signatures"]))
    gain = new["entropy_score"] - old["entropy_score"]
    rise = (gain > 1.0) & ~F.isnan(gain)
    parts = [
        step("Calls", calls, 5), step("Loops", new["loop_count"] - old["loop_count"], 10), step("Branches", new["branch_count"] - old["branch_count"], 2),
        first("AddedGoroutine", "has_go", 15), first("AddedDefer", "has_defer", 3), first("AddedPanic", "has_panic", 5),
        (F.when(rise, F.concat(F.lit("Entropy+"), F.format_string("%.1f", F.bround(gain, 1)))), F.when(rise, (gain * 3).cast("int")).otherwise(0)),
    ]
    label = F.concat_ws(", ", *[p for p, _ in parts])
    risk = reduce(lambda x, y: x + y, [r for _, r in parts])
    return F.struct(F.when(label == "", "NoStructuralChange").otherwise(label).alias("label"), risk.cast("int").alias("risk"), gain.alias("entropy_gain"))


def empty_side() -> dict[str, Column]:
    """A feature row with nothing in it, what an added function is compared with."""
    cols: dict[str, Column] = {c: F.lit(0) for c in COUNTS}
    cols |= {c: F.lit(False) for c in FLAGS}
    cols |= {c: F.create_map().cast("map<string,int>") for c in MAPS}
    return cols | {c: F.array().cast("array<string>") for c in LISTS} | {"entropy_score": F.lit(0.0)}


# ---------------------------------------------------------------- loops


def trip_count(start: Column, limit: Column, step: Column, op: Column) -> Column:
    """Times a counted loop with constant bounds runs; null if it never ends or cannot be told.

    ``op`` compares the counter with the limit.  Not-equal loops need a step of 1 or -1.
    """
    up, down = op.isin("<", "<="), op.isin(">", ">=")
    closed = op.isin("<=", ">=").cast("int")
    span = F.when(up, limit - start).otherwise(start - limit)
    dead = (span < 0) | ((span == 0) & (closed == 0))
    pace = F.when(up, step).otherwise(-step)
    # Round up unless the limit itself is included.
    runs = F.floor((span + pace - 1 + closed) / F.when(pace > 0, pace))
    counted = F.when(dead, 0).when(pace <= 0, None).otherwise(F.greatest(runs, F.lit(0)))
    ne = F.when(start == limit, 0).when(step == 1, F.greatest(limit - start, F.lit(0))).when(step == -1, F.greatest(start - limit, F.lit(0)))
    return F.when(up | down, counted).when(op == "!=", ne).cast("long")


def affine_at(start: Column, step: Column, k: Column) -> Column:
    """Value of {start, +, step} at iteration ``k``, in 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    return (wide(start) + wide(step) * wide(k)).cast("decimal(38,0)")
