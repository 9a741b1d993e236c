"""All similar pairs between set-valued records: multi-index binary sketches.

1. Records with equal sets become one class; the class id is a digest of the set, so no
   group of copies is ever gathered.
2. A value held by a single class cannot be shared.  A class with fewer than
   ceil(t * size) shareable values has no partner and leaves (exact).
3. One-bit minhashes are packed into 64-bit words: a pair with Jaccard J agrees in a bit
   with probability (1 + J) / 2.  The code is cut into segments, each an index of its own.  By the
   pigeonhole principle a pair meets in a segment unless each holds one of its differing bits.  At J = 0.7 15
   percent of the bits differ, more than there are segments, so for these the principle holds with a
   probability instead of surely: ``plan`` makes as many segments as bring a pair at the threshold together with the wanted
   recall.  Their width is log2 of the number of classes, so unrelated classes meet about once per
   segment whatever the size of the table.
4. The Hamming radius over the check words is the binomial quantile for the same recall.
   Pairs that meet and lie within it are verified on the original sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize

WORD, NARROW, WIDE = 64, 12, 24  # bits of a word, least and greatest width of a segment
HOT_CLASSES, SALTS = 1000, 32  # classes with over a thousandth of the rows, a thousand at most, are spread over salts


@dataclass(frozen=True)
class SketchPlan:
    width: int  # bits of a segment
    segments: int
    words: int  # 64-bit words of one-bit minhashes
    check_words: int  # leading words whose Hamming distance is tested
    radius: int  # accepted distance over the check words
    recall: float  # expected for a pair exactly at the threshold


def plan(threshold: float, classes: int, recall: float = 0.998, check_words: int = 4) -> SketchPlan:
    """Segments and radius for a pair at ``threshold``; pairs above it are found more often."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must be in (0, 1] and recall in (0, 1)")
    same = (1 + threshold) / 2
    width = min(WIDE, max(NARROW, math.ceil(math.log2(max(2, classes)))))
    hit = same**width
    segments = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
    words = max(check_words, math.ceil(segments * width / WORD))
    bits, p, radius, mass = check_words * WORD, 1 - same, 0, 0.0
    while True:
        mass += math.comb(bits, radius) * p**radius * same ** (bits - radius)
        if mass >= 1 - (1 - recall) / 8 or radius == bits:
            break
        radius += 1
    return SketchPlan(width, segments, words, check_words, radius, (1 - (1 - hit) ** segments) * mass)


def set_id(tokens: Column) -> Column:
    """Digest of a sorted set; JSON keeps value borders unambiguous."""
    return F.unhex(F.md5(F.to_json(tokens)))


def classes_of(rows: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(row_id, class_id) and (class_id, tokens, size, hashes) of the rows with at least ``min_size`` values, both written."""
    kept = rows.where(F.size("tokens") >= min_size).select("row_id", set_id(F.col("tokens")).alias("class_id"), "tokens")
    kept = materialize(kept, "set-rows")
    sets = kept.select("class_id", "tokens").dropDuplicates(["class_id"]).select(
        "class_id", "tokens", F.size("tokens").alias("size"), F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes")
    )
    return kept.select("row_id", "class_id"), materialize(sets, "sets")


def shareable(sets: DataFrame, threshold: float) -> DataFrame:
    """Sets with enough values that some other class holds too (step 2).

    Counts the values that a single class holds, by class; no join on values, so a value that a third of all
    classes hold is combined map-side.  Values and classes are told apart by 64-bit hashes here.
    """
    values = sets.select(F.xxhash64("class_id").alias("owner"), F.explode("hashes").alias("h"))
    alone = values.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("owner").alias("owner")).where("df = 1").groupBy("owner").agg(F.count(F.lit(1)).alias("alone"))
    marked = sets.withColumn("owner", F.xxhash64("class_id")).join(alone, "owner", "left")
    enough = F.col("size") - F.coalesce("alone", F.lit(0)) >= F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9))
    return marked.where(enough).drop("owner", "alone")


def sketches(sets: DataFrame, p: SketchPlan, seed: int = 20250) -> DataFrame:
    """(class_id, size, check array<long>, segs array<long>): the check words and the segments of the code.

    A segment is its bits and its number in one integer, so one equality joins segment by segment.
    """
    words, bits, used = p.words, p.words * WORD, p.segments * p.width

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        mul = rng.integers(0, 2**63, bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, bits, dtype=np.uint64)
        place = np.uint64(1) << np.arange(WORD, dtype=np.uint64)
        number = np.arange(p.segments, dtype=np.int64) << p.width
        weight = np.int64(1) << np.arange(p.width, dtype=np.int64)
        for batch in batches:
            check, segs = [], []
            for at in range(0, len(batch), 64):
                part = batch["hashes"].iloc[at : at + 64]
                least = np.empty((len(part), bits), dtype=np.uint64)
                for k, h in enumerate(part):
                    x, best = np.asarray(h, dtype=np.int64).view(np.uint64), None
                    for a in range(0, len(x), 256):
                        m = (x[a : a + 256, None] * mul + add).min(axis=0)
                        best = m if best is None else np.minimum(best, m)
                    least[k] = best
                bit = ((least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
                packed = (bit.reshape(len(part), words, WORD) * place).sum(axis=2, dtype=np.uint64)
                check += list(packed[:, : p.check_words].copy().view(np.int64))
                segs += list((bit[:, :used].astype(np.int64).reshape(len(part), p.segments, p.width) * weight).sum(axis=2) | number)
            yield pd.DataFrame({"class_id": batch["class_id"], "size": batch["size"], "check": check, "segs": segs})

    return sets.select("class_id", "size", "hashes").mapInPandas(codes, "class_id binary, size int, check array<long>, segs array<long>")


def candidates(coded: DataFrame, p: SketchPlan, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, that share a code segment and lie within the radius."""
    words = range(p.check_words)

    def side(c: str) -> DataFrame:
        kept = [F.element_at("check", i + 1).alias(f"{c}{i}") for i in words]
        return coded.select(F.col("class_id").alias(c), F.col("size").alias("n" + c), *kept, F.explode("segs").alias("seg"))

    far = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in words), F.lit(0))
    low = F.lit(threshold - 1e-9)
    near = (F.col("a") < F.col("b")) & (F.col("na") >= low * F.col("nb")) & (F.col("nb") >= low * F.col("na")) & (far <= p.radius)
    return side("a").join(side("b"), "seg").where(near).select("a", "b").distinct()


def jaccard_at_least(x: Column, y: Column, threshold: float) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return shared >= (F.size(x) + F.size(y) - shared) * F.lit(threshold) - F.lit(1e-9)


def class_pairs(sets: DataFrame, threshold: float, recall: float = 0.998) -> DataFrame:
    """Verified (class_a, class_b, jaccard) of different sets with Jaccard >= ``threshold``."""
    open_sets = materialize(shareable(sets, threshold), "open-sets")
    p = plan(threshold, open_sets.count(), recall)
    found = materialize(candidates(materialize(sketches(open_sets, p), "sketches"), p, threshold), "candidates")
    ta = open_sets.select(F.col("class_id").alias("a"), F.col("tokens").alias("x"))
    tb = open_sets.select(F.col("class_id").alias("b"), F.col("tokens").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        found.join(ta, "a").join(tb, "b").where(jaccard_at_least(F.col("x"), F.col("y"), threshold))
        .select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), (shared / (F.size("x") + F.size("y") - shared)).alias("jaccard"))
    )


def similar_sets(rows: DataFrame, threshold: float = 0.7, min_size: int = 4, recall: float = 0.998) -> tuple[DataFrame, DataFrame]:
    """Similarity self-join in its compact form: (row_id, class_id) and pairs of classes.

    ``rows``: ``row_id long, tokens array<string>`` of sorted distinct values.  Rows
    with fewer than ``min_size`` values, null ``tokens`` or a null ``row_id`` take no part.
    Members of one class are equal sets and similar to each other by definition.
    Two tables are joined by their union with distinct ``row_id``.
    """
    members, sets = classes_of(rows.where("row_id is not null"), min_size)
    return members, class_pairs(sets, threshold, recall)


def similar_rows(rows: DataFrame, threshold: float = 0.7, min_size: int = 4, recall: float = 0.998) -> DataFrame:
    """(row_a, row_b), row_a < row_b: the class pairs and the copies within a class, row by row.

    A class with over a thousandth of the rows (there are a thousand at most, so their ids are broadcast) is spread over salts: its
    members by hash, and what is joined to it once per salt.
    """
    members, pairs = similar_sets(rows, threshold, min_size, recall)
    least = max(HOT_CLASSES, members.count() // HOT_CLASSES)
    hot = materialize(members.groupBy("class_id").count().where(F.col("count") > least).select("class_id", F.lit(True).alias("hot")), "hot-classes")

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), "class_id", "left")

    def dealt(row: str) -> DataFrame:
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("row_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
        return marked(members).select("class_id", salt.alias("salt"), F.col("row_id").alias(row))

    def repeated(df: DataFrame) -> DataFrame:
        every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return marked(df).withColumn("salt", F.explode(every)).drop("hot")

    first = repeated(pairs.select(F.col("class_a").alias("class_id"), "class_b")).join(dealt("ra"), ["class_id", "salt"]).select("ra", F.col("class_b").alias("class_id"))
    across = repeated(first).join(dealt("rb"), ["class_id", "salt"]).select("ra", "rb")
    within = repeated(members.withColumnRenamed("row_id", "ra")).join(dealt("rb"), ["class_id", "salt"]).where("ra < rb").select("ra", "rb")
    return across.unionByName(within).select(F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b"))


def similar_counts(rows: DataFrame, threshold: float = 0.7, min_size: int = 4, recall: float = 0.998) -> DataFrame:
    """One row per record: its class and its number of partners (copies included), no pair expanded."""
    members, pairs = similar_sets(rows, threshold, min_size, recall)
    sizes = materialize(members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies")), "class-sizes")
    both = pairs.select("class_a", "class_b").union(pairs.select("class_b", "class_a")).toDF("class_id", "other")
    links = both.join(sizes.withColumnRenamed("class_id", "other"), "other").groupBy("class_id").agg(F.sum("copies").alias("near"))
    return (
        members.join(sizes, "class_id").join(links, "class_id", "left")
        .select("row_id", F.lower(F.hex("class_id")).alias("class_id"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    )
