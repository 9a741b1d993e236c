"""Items that appear together: pair counts, pointwise mutual information and lift.

Equal baskets are collapsed into one weighted basket first, so a basket repeated
a billion times emits its pairs once.  Items that cannot reach ``min_count``
are removed before pairs are made, which is exact because a pair never
occurs more often than its rarer item.  Pair counts are combined map-side by
Spark's partial aggregation.  A basket with more than ``block`` items left is cut
into blocks and each pair of blocks becomes a row of its own, so no task
has to emit all pairs of a huge basket.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize


def cooccurrence(records: DataFrame, min_count: int = 1, min_share: float = 0.0, block: int = 256) -> DataFrame:
    """Count pairs of items within records.

    ``records``: ``field string, items array<string>`` with distinct sorted items;
    further columns are ignored.  A record with no item still counts in ``n``.
    Only pairs with count >= ``min_count`` and count / n >= ``min_share`` come out.

    Returns ``field, item_a, item_b, n, count_a, count_b, count_ab, pmi, lift``
    with ``item_a < item_b``; pmi is in nats.  An empty table gives no row; a null
    ``items`` counts as an empty record; a null field is a field of its own.
    """
    if min_count < 1 or not 0 <= min_share <= 1:
        raise ValueError("min_count must be at least 1 and min_share in [0, 1]")
    empty = F.array().cast("array<string>")
    baskets = materialize(
        records.select("field", F.coalesce("items", empty).alias("items"))
        .groupBy("field", "items").agg(F.count(F.lit(1)).alias("w"))
        .withColumn("basket", F.monotonically_increasing_id()),
        "baskets",
    )
    totals = baskets.groupBy(F.col("field").alias("ft")).agg(F.sum("w").alias("n"))
    least = F.greatest(F.lit(min_count), F.ceil(F.col("n") * F.lit(min_share) - F.lit(1e-9)))
    single = (
        baskets.select("field", "w", F.explode("items").alias("item"))
        .groupBy("field", "item").agg(F.sum("w").alias("cnt"))
        .join(totals, F.col("field").eqNullSafe(F.col("ft")))
        .select("field", "item", "cnt", "n", least.alias("least"))
        .where("cnt >= least")
    )
    single = materialize(single, "marginals")
    kept = (
        baskets.where(F.size("items") > 1)
        .select("field", "basket", "w", F.explode("items").alias("item"))
        .join(single.select(F.col("field").alias("f2"), F.col("item").alias("i2")), F.col("field").eqNullSafe(F.col("f2")) & (F.col("item") == F.col("i2")))
        .groupBy("field", "basket", "w").agg(F.array_sort(F.collect_list("item")).alias("items"))
        .where(F.size("items") > 1)
    )
    if min_count == 1 and min_share == 0:
        kept = baskets.where(F.size("items") > 1)
    pairs = (
        _pairs(kept, block)
        .groupBy("field", "item_a", "item_b").agg(F.sum("w").alias("count_ab"))
    )
    a = single.select(F.col("field").alias("fa"), F.col("item").alias("ia"), F.col("cnt").alias("count_a"), "n", "least")
    b = single.select(F.col("field").alias("fb"), F.col("item").alias("ib"), F.col("cnt").alias("count_b"))
    n, c, ca, cb = (F.col(x).cast("double") for x in ("n", "count_ab", "count_a", "count_b"))
    return (
        pairs.join(a, F.col("field").eqNullSafe(F.col("fa")) & (F.col("item_a") == F.col("ia")))
        .where("count_ab >= least")
        .join(b, F.col("field").eqNullSafe(F.col("fb")) & (F.col("item_b") == F.col("ib")))
        .select(
            "field", "item_a", "item_b", "n", "count_a", "count_b", "count_ab",
            F.log(c * n / (ca * cb)).alias("pmi"), (c * n / (ca * cb)).alias("lift"),
        )
    )


def _pairs(kept: DataFrame, block: int) -> DataFrame:
    """(field, item_a, item_b, w) of every pair in every basket; generators only, no self-join."""
    small = kept.where(F.size("items") <= block).select("field", "w", F.posexplode("items").alias("i", "item_a"), "items").select(
        "field", "item_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b"), "w"
    )
    parts = F.ceil(F.size("items") / F.lit(block)).cast("int")
    cut = lambda k: F.slice(F.col("items"), k * block + 1, F.lit(block))
    corner = kept.where(F.size("items") > block).select("field", "w", "items", F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"))
    grid = corner.select("field", "w", "items", "p", F.explode(F.sequence(F.col("p"), parts - 1)).alias("q"))
    tiles = grid.select("field", "w", "p", "q", cut(F.col("p")).alias("left"), cut(F.col("q")).alias("right")).repartition(F.col("p"), F.col("q"), F.xxhash64("left", "right"))
    large = (
        tiles.select("field", "w", "right", F.explode("left").alias("item_a"))
        .select("field", "item_a", F.explode(F.filter("right", lambda x: x > F.col("item_a"))).alias("item_b"), "w")
    )
    return small.unionByName(large)


def tied_pairs(records: DataFrame, min_count: int = 5, min_share: float = 0.01, min_lift: float = 4.0) -> DataFrame:
    """Pairs that occur often enough and far more often than chance."""
    if not math.isfinite(min_lift):
        raise ValueError("min_lift must be finite")
    found = cooccurrence(records, min_count, min_share)
    c, n, a, b = (F.col(x) for x in ("count_ab", "n", "count_a", "count_b"))
    return found.where(c.cast("double") * n.cast("double") >= F.lit(min_lift) * (a.cast("double") * b.cast("double")))
