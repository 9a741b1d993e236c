"""Comparing two versions of a code base.

A version is a table ``func_id, function_name, key, bucket, fingerprint, features struct``.  Functions are paired by
short name, the rest by structure within a bucket, one to one; what is left was added or removed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, scoring
from ..workspace import materialize

MATCH_THRESHOLD, HIGH_RISK, ADDED_RISK = 0.6, 10, 5
FEATURES = (*scoring.COUNTS, *scoring.FLAGS, *scoring.MAPS, *scoring.LISTS, "entropy_score", "obfuscation")


def version(functions: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """Feature rows as a version: key, bucket, fingerprint and features.

    ``prints(func_id, fingerprint)`` are canonical fingerprints; without them the hash of the structure stands in.
    """
    f = scoring.side()
    bucket = names.fuzzy_hash(f["block_count"], f["loop_count"], f["branch_count"], f["param_count"], f["return_count"])
    number = F.col("func_id") if "func_id" in functions.columns else F.lit(None).cast("long").alias("func_id")
    rows = functions.select(
        number, "function_name", names.join_name(F.col("function_name")).alias("key"), bucket.alias("bucket"), F.sha2(scoring.hash_text(f), 256).alias("fingerprint"),
        F.struct(*[F.col(c) for c in FEATURES]).alias("features"),
    )
    return rows if prints is None else rows.drop("fingerprint").join(prints.select("func_id", "fingerprint"), "func_id", "left").select(rows.columns)


def last_by_key(v: DataFrame) -> DataFrame:
    """One row per short name, the last by full name; rows without a name do not take part.

    An aggregate and not a window: a name like ``main`` that every package has is combined map-side.
    """
    last = F.max_by(F.struct(*[c for c in v.columns if c != "key"]), F.struct("function_name", "fingerprint"))
    return v.where("function_name is not null").groupBy("key").agg(last.alias("v")).select("key", "v.*")


def _prefixed(v: DataFrame, mark: str) -> DataFrame:
    return v.select(*[F.col(c).alias(mark + c) for c in v.columns])


def match_by_name(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs with equal short name, with their similarity."""
    pairs = _prefixed(last_by_key(old), "old_").join(_prefixed(last_by_key(new), "new_"), F.col("old_key") == F.col("new_key"))
    return pairs.withColumn("similarity", scoring.topology_similarity(scoring.side("old_features"), scoring.side("new_features"))).withColumn("by_name", F.lit(True))


def unmatched(v: DataFrame, other: DataFrame) -> DataFrame:
    """Functions whose short name the other version lacks."""
    keys = other.where("function_name is not null").select("key").distinct()
    return last_by_key(v).join(keys, "key", "left_anti")


def bucket_candidates(old: DataFrame, new: DataFrame, threshold: float = MATCH_THRESHOLD, blocks: int = 8) -> DataFrame:
    """Left-over pairs in the same bucket with enough similarity; a bucket is dealt to ``blocks`` tasks by its old side."""
    left = _prefixed(old, "old_").withColumn("block", F.pmod(F.xxhash64("old_function_name"), F.lit(blocks)).cast("int"))
    right = _prefixed(new, "new_").withColumn("new_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = left.join(right, (F.col("old_bucket") == F.col("new_bucket")) & (F.col("block") == F.col("new_block"))).drop("block", "new_block")
    sim = scoring.topology_similarity(scoring.side("old_features"), scoring.side("new_features"))
    return pairs.withColumn("similarity", sim).where(F.col("similarity") >= threshold)


LOCAL_PAIRS = 100_000  # pairs of a bucket that one task assigns


def assign(pairs: DataFrame, local: int = LOCAL_PAIRS) -> DataFrame:
    """Greedy one-to-one assignment by falling similarity, ties by old then new name.

    ``pairs(old_bucket, old_function_name, new_function_name, similarity)``.  Pairs of different buckets share no
    function, so each bucket is assigned on its own, in one task if it has at most ``local`` pairs, else in rounds
    (``assign_rounds``), with the same outcome.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["similarity", "old_function_name", "new_function_name"], ascending=[False, True, True], kind="stable")
        old, new, kept = set(), set(), []
        for at, (a, b) in enumerate(zip(pdf["old_function_name"], pdf["new_function_name"])):
            if a not in old and b not in new:
                old.add(a)
                new.add(b)
                kept.append(at)
        return pdf.iloc[kept]

    rows = materialize(pairs.select(*ASSIGNED), "assign-pairs")
    big = materialize(rows.groupBy("old_bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local).select("old_bucket"), "big-buckets")
    small = rows.join(big, "old_bucket", "left_anti").select(*ASSIGNED).groupBy("old_bucket").applyInPandas(greedy, "old_bucket string, old_function_name string, new_function_name string, similarity double")
    if big.isEmpty():
        return small
    return small.unionByName(assign_rounds(rows.join(big, "old_bucket", "left_semi").select(*ASSIGNED)))


ASSIGNED = ("old_bucket", "old_function_name", "new_function_name", "similarity")


def assign_rounds(pairs: DataFrame) -> DataFrame:
    """The greedy assignment in rounds: pairs that are the best of both their functions are what greedy takes first."""
    rank = F.struct((-F.col("similarity")).alias("loss"), "old_function_name", "new_function_name", "old_bucket")
    best = lambda side: rest.groupBy(side).agg(F.min(rank).alias("best")).select("best.*")
    rest, taken = pairs, []
    while not rest.isEmpty():
        mutual = materialize(best("old_function_name").join(best("new_function_name"), ["loss", "old_function_name", "new_function_name", "old_bucket"]), "mutual-best")
        taken.append(mutual.select("old_bucket", "old_function_name", "new_function_name", (-F.col("loss")).alias("similarity")))
        rest = rest.join(mutual.select("old_function_name"), "old_function_name", "left_anti").join(mutual.select("new_function_name"), "new_function_name", "left_anti")
        rest = materialize(rest.select(*ASSIGNED), "unassigned")
    return reduce(DataFrame.unionByName, taken) if taken else pairs


def diff(old: DataFrame, new: DataFrame, threshold: float = MATCH_THRESHOLD, deltas: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per function: function, status, fingerprint_match, fingerprints, matched_nodes, added_ops, removed_ops, risk_score, topology_delta, similarity, by_name.

    Status: preserved if the fingerprints are equal or ``deltas`` finds every instruction matched, else modified; a pair found
    by structure is renamed whatever its status.  Added and removed are what found no partner.  Risk is
    counted for modified pairs and for added functions (5 and what they bring).

    ``deltas`` takes ``old_func_id, new_func_id, old_fingerprint, new_fingerprint`` of the pairs with different
    fingerprints and gives ``pair_id`` (the old id), ``status, matched_nodes, added_ops, removed_ops``.
    """
    left, right = materialize(unmatched(old, new), "only-old"), materialize(unmatched(new, old), "only-new")
    fuzzy = materialize(bucket_candidates(left, right, threshold), "bucket-pairs")
    renames = materialize(assign(fuzzy), "renames").select(F.col("old_function_name").alias("ro"), F.col("new_function_name").alias("rn"))
    by_structure = fuzzy.join(renames, (F.col("old_function_name") == F.col("ro")) & (F.col("new_function_name") == F.col("rn"))).drop("ro", "rn").withColumn("by_name", F.lit(False))
    pairs = match_by_name(old, new).unionByName(by_structure)
    same = F.coalesce(F.col("old_fingerprint") == F.col("new_fingerprint"), F.lit(False))
    ops = "array<string>"
    if deltas is None:
        found = pairs.withColumns({"found": F.lit(None).cast("string"), "matched_nodes": F.lit(None).cast("long"), "added_ops": F.lit(None).cast(ops), "removed_ops": F.lit(None).cast(ops)})
    else:
        pairs = materialize(pairs, "pairs")
        d = deltas(pairs.where(~same).select("old_func_id", "new_func_id", "old_fingerprint", "new_fingerprint"))
        d = d.select(F.col("pair_id").alias("old_func_id"), F.col("status").alias("found"), "matched_nodes", "added_ops", "removed_ops")
        found = pairs.join(materialize(d, "deltas"), "old_func_id", "left")
    delta = scoring.risk_delta(scoring.side("old_features"), scoring.side("new_features"))
    state = F.when(same, "preserved").otherwise(F.coalesce("found", F.lit("modified")))
    changed = state == "modified"
    label = lambda c: names.display_name(F.col(c))
    title = F.when(F.col("by_name"), label("old_function_name")).otherwise(F.concat(label("old_function_name"), F.lit(" → "), label("new_function_name")))
    matched = found.select(
        title.alias("function"), F.when(~F.col("by_name"), "renamed").otherwise(state).alias("status"), same.alias("fingerprint_match"),
        F.col("old_fingerprint"), F.col("new_fingerprint"), "matched_nodes", "added_ops", "removed_ops",
        F.when(changed, delta["risk"]).otherwise(0).alias("risk_score"), F.when(changed, delta["label"]).alias("topology_delta"),
        F.col("similarity"), F.col("by_name"),
    )
    none = F.lit(None)
    gone = left.join(renames, F.col("function_name") == F.col("ro"), "left_anti").select(
        label("function_name").alias("function"), F.lit("removed").alias("status"), F.lit(False).alias("fingerprint_match"), F.col("fingerprint").alias("old_fingerprint"),
        none.cast("string").alias("new_fingerprint"), none.cast("long").alias("matched_nodes"), none.cast(ops).alias("added_ops"), none.cast(ops).alias("removed_ops"), F.lit(0).alias("risk_score"), none.cast("string").alias("topology_delta"), none.cast("double").alias("similarity"), none.cast("boolean").alias("by_name"),
    )
    fresh_delta = scoring.risk_delta(scoring.empty_side(), scoring.side("features"))
    fresh = right.join(renames, F.col("function_name") == F.col("rn"), "left_anti").select(
        label("function_name").alias("function"), F.lit("added").alias("status"), F.lit(False).alias("fingerprint_match"), none.cast("string").alias("old_fingerprint"),
        F.col("fingerprint").alias("new_fingerprint"), none.cast("long").alias("matched_nodes"), none.cast(ops).alias("added_ops"), none.cast(ops).alias("removed_ops"), (ADDED_RISK + fresh_delta["risk"]).alias("risk_score"), fresh_delta["label"].alias("topology_delta"), none.cast("double").alias("similarity"), none.cast("boolean").alias("by_name"),
    )
    return matched.unionByName(gone).unionByName(fresh)


def matches(pairs: DataFrame, *keep: str) -> DataFrame:
    """(keep, old_function, new_function, similarity, matched_by_name, old_topology, new_topology) of matched pairs."""
    def shape(mark: str) -> Column:
        f = scoring.side(mark + "features")
        return names.topology_label(f["loop_count"], f["branch_count"], f["instr_count"], F.array_sort(F.map_keys(f["call_signatures"])))

    return pairs.select(
        *keep, names.display_name(F.col("old_function_name")).alias("old_function"), names.display_name(F.col("new_function_name")).alias("new_function"),
        "similarity", F.col("by_name").alias("matched_by_name"), shape("old_").alias("old_topology"), shape("new_").alias("new_topology"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """Counts and percentages of a diff; renamed pairs count as modified too."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    total = F.count(F.lit(1))
    pct = lambda part: F.when(total > 0, part / total * 100).otherwise(0.0)
    return rows.agg(
        total.alias("total_functions"), n("preserved").alias("preserved"), n("modified", "renamed").alias("modified"), n("added").alias("added"), n("removed").alias("removed"),
        n("renamed").alias("renamed_functions"), F.count_if(F.col("risk_score") >= HIGH_RISK).alias("high_risk_changes"),
        pct(n("preserved")).alias("semantic_match_pct"), pct(n("preserved", "modified", "renamed")).alias("topology_matched_pct"),
    )
