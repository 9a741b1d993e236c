"""Top N items within every group by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(scored: DataFrame, group: str, item: str, score: str, n: int, salts: int = 32) -> DataFrame:
    """The ``n`` best items of every group, each item with its highest score.

    Rows with a null group, item or score, or a NaN score, do not count.  Ties
    are broken by the item, upwards by code point.  Extra columns are
    dropped before the shuffle.  Returns ``group, item, score, rank``.

    Stage one ranks within (group, salt) where the salt comes from the item, so a
    group with a third of all rows is spread over ``salts`` tasks and each passes on
    at most ``n`` rows; stage two ranks those survivors per group.
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be at least 1")
    g, i, s = (scored[x] for x in (group, item, score))
    rows = scored.select(g.alias("g"), i.alias("i"), s.alias("s")).where(
        "g is not null and i is not null and s is not null and not isnan(s)"
    )
    best = rows.groupBy("g", "i").agg(F.max("s").alias("s")).withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts)))
    order: list[Column] = [F.col("s").desc(), F.col("i").asc()]
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).where(F.col("rank") <= n)
    last = first.drop("rank", "salt").withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)
    return last.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
