"""Matching functions against a signature table.

The indexed modes write the OR of hash and bucket as a union of two equi joins, because an OR in a
join condition would become a nested loop; the second branch leaves out the pairs of the first, so no
duplicate has to be removed by a shuffle.  No side is broadcast by hint: both grow with the data,
and the optimizer broadcasts a small one by its measured size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entropy, names, scoring
from ..workspace import materialize

DEFAULT_TOLERANCE, DEFAULT_THRESHOLD, EXACT_THRESHOLD = 0.5, 0.75, 0.99

SIGNATURE = (
    "id", "name", "severity", "topology_hash", "fuzzy_hash", "entropy_score", "entropy_tolerance", "node_count", "loop_depth", "required_calls", "string_patterns",
)


def probes(functions: DataFrame) -> DataFrame:
    """What a scan needs of a feature row, the topology hash computed once."""
    f = scoring.side()
    return functions.select(
        "func_id", "function_name", scoring.topology_hash(f).alias("hash"), names.fuzzy_hash(f["block_count"], f["loop_count"], f["branch_count"], f["param_count"], f["return_count"]).alias("bucket"),
        f["entropy_score"].alias("entropy"), f["block_count"].alias("blocks"), f["loop_count"].alias("loops"), F.map_keys(f["call_signatures"]).alias("calls"),
        F.array_compact(f["string_literals"]).alias("literals"), F.col("obfuscation.score").alias("obf_score"), F.col("obfuscation.class").alias("obf_class"),
        F.col("obfuscation.indirect_call_ratio").alias("indirect"),
    )


def index_functions(functions: DataFrame) -> DataFrame:
    """Signature rows made from feature rows (one each); ids number the functions of a category."""
    f = scoring.side()
    calls = F.array_sort(F.map_keys(f["call_signatures"]))
    return functions.select(
        F.concat(F.lit("SFW-IDX-"), F.lpad(F.col("func_id").cast("string"), 12, "0")).alias("id"), F.col("function_name").alias("name"), F.lit("HIGH").alias("severity"),
        scoring.topology_hash(f).alias("topology_hash"), names.fuzzy_hash(f["block_count"], f["loop_count"], f["branch_count"], f["param_count"], f["return_count"]).alias("fuzzy_hash"),
        f["entropy_score"].alias("entropy_score"), F.lit(0.5).alias("entropy_tolerance"), f["block_count"].alias("node_count"), f["loop_count"].alias("loop_depth"),
        calls.alias("required_calls"), scoring.string_patterns(f["string_literals"]).alias("string_patterns"),
        ((f["loop_count"] > 0) & ~f["has_range"]).alias("has_infinite_loop"), scoring.has_reconnect(calls, f["loop_count"]).alias("has_reconnect_logic"),
        F.col("obfuscation.score").alias("obfuscation_score"),
    )


def _sides(signatures: DataFrame, *extra: str) -> DataFrame:
    return signatures.select(*[F.col(c).alias("s_" + c) for c in (*SIGNATURE, *extra)])


def score(pairs: DataFrame, default_tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """Confidence and evidence of (probe, signature) pairs; see ``scoring.match_score``."""
    c = F.col
    same = c("hash") == c("s_topology_hash")
    likeness = scoring.signature_similarity(c("blocks"), c("loops"), c("s_node_count"), c("s_loop_depth"))
    out = pairs.select(
        "*", same.alias("same_hash"), likeness.alias("likeness"), entropy.entropy_distance(c("entropy"), c("s_entropy_score")).alias("entropy_distance"),
        scoring.calls_found(c("s_required_calls"), c("calls")).alias("calls_matched"), scoring.calls_missing(c("s_required_calls"), c("calls")).alias("calls_missing"),
        scoring.patterns_found(c("s_string_patterns"), c("literals")).alias("strings_matched"),
    )
    confidence = scoring.match_score(
        F.coalesce("same_hash", F.lit(False)), c("likeness"), c("entropy_distance"), c("s_entropy_tolerance"), default_tolerance, c("s_required_calls"), c("calls_matched"),
        c("s_string_patterns"), c("strings_matched"), c("obf_score"), c("obf_class"), c("indirect"),
    )
    similarity = F.when(c("same_hash"), 1.0).otherwise(c("likeness"))
    return out.withColumns({
        "confidence": confidence, "topology_similarity": similarity, "topology_match": F.coalesce("same_hash", F.lit(False)) | (similarity > 0.8),
        "entropy_match": c("entropy_distance") <= entropy.effective_tolerance(c("s_entropy_tolerance"), default_tolerance),
    })


def sure(confidence: Column, least: float) -> Column:
    """At least ``least``; NaN is no confidence, though it sorts above all numbers."""
    return (confidence >= least) & ~F.isnan(confidence)


CELL, CELLS = 0.5, 16  # width and highest number of a cell of entropy


def _cell(entropy_of: Column) -> Column:
    """Cell of an entropy, 0 for null and NaN; values outside 0..8 fall into the cells at the ends."""
    at = F.floor(entropy_of / CELL)
    return F.when(entropy_of.isNull() | F.isnan(entropy_of), 0).otherwise(F.greatest(F.lit(0), F.least(at, F.lit(CELLS)))).cast("int")


def _cells(s: DataFrame, default_tolerance: float) -> DataFrame:
    """A signature in every cell that its entropy band touches, so a probe meets it in its own cell and there alone."""
    tol = entropy.effective_tolerance(F.col("s_entropy_tolerance"), default_tolerance)
    low, high = F.col("s_entropy_score") - tol, F.col("s_entropy_score") + tol
    plain = low.isNotNull() & ~F.isnan(low) & (low <= high)
    every = F.sequence(F.lit(0), F.lit(CELLS))
    return s.withColumn("cell", F.explode(F.when(plain, F.sequence(_cell(low), _cell(high))).otherwise(every)))


def candidates(p: DataFrame, signatures: DataFrame, default_tolerance: float = DEFAULT_TOLERANCE, *extra: str) -> DataFrame:
    """Pairs with equal hash or equal non-empty bucket, within the signature's entropy band.

    The bucket join has the entropy cell in its key, so a full bucket is cut into as many parts and most pairs
    outside the band are never made.
    """
    s = _sides(signatures, *extra)
    band = entropy.within_tolerance(F.col("entropy"), F.col("s_entropy_score"), F.col("s_entropy_tolerance"), default_tolerance)
    by_hash = p.join(s, F.col("hash") == F.col("s_topology_hash"))
    cells = _cells(s.where("s_fuzzy_hash <> ''"), default_tolerance)
    by_bucket = (
        p.withColumn("cell", _cell(F.col("entropy"))).join(cells.withColumnRenamed("cell", "s_cell"), (F.col("bucket") == F.col("s_fuzzy_hash")) & (F.col("cell") == F.col("s_cell")))
        .where(~F.col("hash").eqNullSafe(F.col("s_topology_hash"))).drop("cell", "s_cell")
    )
    return by_hash.unionByName(by_bucket).where(band)


def scan_bucket(p: DataFrame, signatures: DataFrame, threshold: float = DEFAULT_THRESHOLD, tolerance: float = DEFAULT_TOLERANCE, *extra: str) -> DataFrame:
    """Indexed scan: all candidates with enough confidence."""
    return score(candidates(p, signatures, tolerance, *extra), tolerance).where(sure(F.col("confidence"), threshold))


def scan_exact(p: DataFrame, signatures: DataFrame, threshold: float = DEFAULT_THRESHOLD, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """Equal hash, within the band, best confidence per function; ties go to the least id."""
    s = _sides(signatures)
    band = entropy.within_tolerance(F.col("entropy"), F.col("s_entropy_score"), F.col("s_entropy_tolerance"), tolerance)
    scored = score(p.join(s, F.col("hash") == F.col("s_topology_hash")).where(band), tolerance).where(sure(F.col("confidence"), threshold))
    by = Window.partitionBy("func_id").orderBy(F.col("confidence").desc(), F.col("s_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank")


def all_pairs(p: DataFrame, signatures: DataFrame, per_block: int = 500, *extra: str) -> DataFrame:
    """A stated set of probes against every signature, block by block.

    Probes are dealt by hash to blocks of about ``per_block``, at least 16, and every signature visits each block,
    so a task holds one block of probes and the signatures stream past it, and the tasks grow with the probes.
    """
    blocks = max(16, -(-p.count() // per_block))
    s = _sides(signatures, *extra).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return p.withColumn("block", F.pmod(F.xxhash64("func_id"), F.lit(blocks)).cast("int")).join(s, "block").drop("block")


PROBES, SIGNATURES, CELLS_LEAST = 4000, 25_000, 12  # probes and signatures that meet in a task, and blocks of signatures at least
SLACK = 1e-9  # rounding that is allowed for where the score is computed again


def _met(owners: DataFrame, key: str, words: Column, wanted: DataFrame, wanted_key: str, texts: Column) -> tuple[DataFrame, DataFrame]:
    """(key, keys) and (wanted_key, keys): numbers of the texts that occur inside a word of an owner, and of those among the texts of a wanted row.

    Each distinct text is sought once in each distinct word; texts that occur nowhere have no number.
    """
    own = owners.select(key, F.explode(F.array_distinct(words)).alias("word"))
    sought = wanted.select(wanted_key, F.explode(texts).alias("text")).where("text is not null")
    met = materialize(own.select("word").distinct().join(sought.select("text").distinct(), F.col("word").contains(F.col("text"))), "scan-met")
    ids = materialize(met.select("text").distinct().withColumn("id", F.monotonically_increasing_id()), "scan-texts")
    found = own.join(met.join(ids, "text").select("word", "id"), "word").groupBy(key).agg(F.collect_set("id").alias("keys"))
    return found, sought.join(ids, "text").groupBy(wanted_key).agg(F.collect_list("id").alias("keys"))


def _inverted(lists: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of the lists, where the places of each begin, and the places: the rows that list it, once for each time."""
    at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    keys = np.concatenate([*lists]).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return found, np.append(first, len(keys)), at[order]


def _confident(p: pd.DataFrame, s: pd.DataFrame, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the probes and signatures with a confidence of ``least`` (over 0) or more, and the confidence: ``scoring.match_score`` in its order of operations."""

    def hits(index: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        found, first, at = index
        k = np.searchsorted(found, keys)
        k = k[found[np.minimum(k, len(found) - 1)] == keys] if len(found) else k[:0]
        return np.bincount(np.concatenate([at[first[i] : first[i + 1]] for i in k]), minlength=len(s)) if len(k) else np.zeros(len(s), np.int64)

    by_call, by_text = _inverted(s["calls"]), _inverted(s["texts"])
    c = {n: s[n].to_numpy() for n in ("hash", "entropy", "band", "nodes", "depth", "n_calls", "n_texts")}
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    fold = lambda x, y: np.where(y > 0, 0.0 if x <= 0 else np.minimum(x / y, y / x), 0.0)
    with np.errstate(all="ignore"):
        for row, q in enumerate(p.itertuples(index=False)):
            found = hits(by_call, q.calls)
            at = np.flatnonzero(found >= c["n_calls"]) if q.plain else np.arange(len(s))
            if not len(at):
                continue
            nodes, depth, n_calls, n_texts, band = (c[n][at] for n in ("nodes", "depth", "n_calls", "n_texts", "band"))
            stated = (nodes > 0).astype(int) + (depth > 0)
            likeness = np.where(stated > 0, (fold(q.blocks, nodes) + fold(q.loops, depth)) / np.maximum(stated, 1), 0.5)
            same = c["hash"][at] == q.hash if q.hash is not None else np.zeros(len(at), bool)
            distance = np.abs(q.entropy - c["entropy"][at])  # NaN where a value is missing, which is in no band
            text = hits(by_text, q.texts)[at]
            total = np.where(same, 1.0, likeness) + np.where(distance <= band, 1 - distance / band, 0.5)
            total = total + np.where(n_calls > 0, found[at] / np.maximum(n_calls, 1), 0.0) + np.where(text > 0, text / np.maximum(n_texts, 1), 0.0)
            mean = total / (2 + (n_calls > 0) + (text > 0))
            confidence = np.where(mean >= 0.4, np.maximum(mean, 0.5 * q.score), mean)
            kept = np.flatnonzero(confidence >= least)
            out.append((np.full(len(kept), row), at[kept], confidence[kept]))
    i, j, confidence = (np.concatenate(x) for x in zip(*out))
    return i, j, confidence


def confidences(p: DataFrame, signatures: DataFrame, least: float, default_tolerance: float, keep: tuple[str, ...], also: tuple[str, ...]) -> DataFrame:
    """(keep, also, confidence) of every probe with every signature, where the confidence is ``least`` (over 0) or more; ``keep`` are columns of the probes and ``also`` of the signatures.

    All pairs are compared, but by numbers and in blocks: which texts occur inside which is found out once for the distinct
    ones, so what is left for a pair is to count them and to take the mean of its parts.
    """
    p = materialize(p.withColumn("p_no", F.monotonically_increasing_id()), "scan-probes")
    s = materialize(signatures.withColumn("s_no", F.monotonically_increasing_id()), "scan-signatures")
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    calls, required = _met(p, "p_no", F.col("calls"), s, "s_no", F.col("required_calls"))
    texts, patterns = _met(p, "p_no", low(F.col("literals")), s, "s_no", low(F.col("string_patterns")))
    lists = lambda t, a, b, key: t.join(a.withColumnRenamed("keys", "c_keys"), key, "left").join(b.withColumnRenamed("keys", "t_keys"), key, "left")
    keys = [F.coalesce(n, F.array().cast("array<long>")).alias(a) for n, a in (("c_keys", "calls"), ("t_keys", "texts"))]
    number = lambda c: F.col(c).cast("double")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    plain = (F.coalesce("indirect", F.lit(0.0)) < 0.5) & F.coalesce("obf_class", F.lit("NONE")).isin(*scoring.CLASSES[:2])
    probe = lists(p, calls, texts, "p_no").select(
        "p_no", *[F.col(c).alias("k_" + c) for c in keep], "hash", number("entropy").alias("entropy"), number("blocks").alias("blocks"), number("loops").alias("loops"),
        *keys, F.coalesce(number("obf_score"), F.lit(0.0)).alias("score"), plain.alias("plain"),
    )
    band = entropy.effective_tolerance(number("entropy_tolerance"), default_tolerance)
    sig = lists(s, required, patterns, "s_no").select(
        "s_no", *[F.col(c).alias("a_" + c) for c in also], F.col("topology_hash").alias("hash"), number("entropy_score").alias("entropy"), band.alias("band"), number("node_count").alias("nodes"),
        number("loop_depth").alias("depth"), *keys, size("required_calls").alias("n_calls"), size("string_patterns").alias("n_texts"),
    )
    across, down = max(CELLS_LEAST, -(-s.count() // SIGNATURES)), max(1, -(-p.count() // PROBES))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    probe = probe.withColumn("across", every(across)).withColumn("cell", F.col("across") * down + dealt("p_no", down)).drop("p_no", "across")
    sig = sig.withColumn("down", every(down)).withColumn("cell", dealt("s_no", across) * down + F.col("down")).drop("s_no", "down")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        i, j, confidence = _confident(a, b, least)
        kept = {"k_" + c: a["k_" + c].take(i).array for c in keep} | {"a_" + c: b["a_" + c].take(j).array for c in also}
        return pd.DataFrame(kept | {"confidence": confidence})

    kinds = [f"k_{c} {dict(p.dtypes)[c]}" for c in keep] + [f"a_{c} {dict(s.dtypes)[c]}" for c in also]
    return probe.groupBy("cell").cogroup(sig.groupBy("cell")).applyInPandas(meet, ", ".join([*kinds, "confidence double"]))


def pairs_reaching(p: DataFrame, signatures: DataFrame, least: float, default_tolerance: float = DEFAULT_TOLERANCE, *extra: str) -> DataFrame:
    """The pairs of ``all_pairs`` whose confidence is ``least`` or more."""
    if not least > 0:
        return all_pairs(p, signatures, 500, *extra)
    p = materialize(p.withColumn("no", F.monotonically_increasing_id()), "scan-numbered")
    s = materialize(signatures.withColumn("no", F.monotonically_increasing_id()), "scan-numbered")
    kept = materialize(confidences(p, s, least - SLACK, default_tolerance, ("no",), ("no",)).select("k_no", "a_no"), "scan-pairs")
    return kept.join(p.withColumnRenamed("no", "k_no"), "k_no").join(_sides(s, *extra, "no").withColumnRenamed("s_no", "a_no"), "a_no").drop("k_no", "a_no")


def scan_full(p: DataFrame, signatures: DataFrame, threshold: float = DEFAULT_THRESHOLD, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """Unindexed scan: every probe against every signature, no entropy gate."""
    return score(pairs_reaching(p, signatures, threshold, tolerance), tolerance).where(sure(F.col("confidence"), threshold))


def scan_full_exact(p: DataFrame, signatures: DataFrame, position: str) -> DataFrame:
    """Unindexed exact scan: per probe the first signature by ``position`` with confidence of 0.99 or more.

    The default band is 0, so an unset band with equal entropy is 0/0 and never a match.
    """
    scored = score(pairs_reaching(p, signatures, EXACT_THRESHOLD, 0.0, position), 0.0).where(sure(F.col("confidence"), EXACT_THRESHOLD))
    by = Window.partitionBy("func_id").orderBy("s_" + position)
    return scored.withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank")


def severity_rollup(alerts: DataFrame) -> DataFrame:
    """One row: alerts in all and by severity; unknown severities count only in the total."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return alerts.agg(F.count(F.lit(1)).alias("total"), n("CRITICAL"), n("HIGH"), n("MEDIUM"), n("LOW"))
