"""How characteristic a term is of its record: smoothed language-model divergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize


def distinctiveness(records: DataFrame, mu: float = 10.0, min_df: int = 2, hot_share: float = 0.001, hot_limit: int = 50_000) -> DataFrame:
    """Score every term of every record.

    ``records``: ``field, record_key, items array<string>`` with distinct items.
    With L items in the record, p_c the share of the term in all items of
    the field and p_d = (1 + mu p_c) / (L + mu), the score is p_d log(p_d / p_c), the
    term's part of the relative entropy between the Dirichlet-smoothed record
    and the collection.  It falls strictly as more records hold the term.  Terms held
    by fewer than ``min_df`` records get no row.  Null or empty lists give no row.

    Returns ``field, record_key, record_id, term, df, n_terms, score``.

    Terms in more than ``hot_share`` of a field's records are few by arithmetic (at most
    items per record / hot_share); if their bound is within ``hot_limit`` they are
    broadcast, so a term that every third record holds never meets one task.
    The rest joins by shuffle.
    """
    if mu <= 0 or min_df < 1:
        raise ValueError("mu must be positive and min_df at least 1")
    # Null keys make rows records of their own, so an id of the written rows, not the key, tells records apart.
    records = materialize(records.select("field", "record_key", "items", F.monotonically_increasing_id().alias("record_id")).where(F.size("items") > 0), "records")
    terms = records.select("field", "record_key", "record_id", F.size("items").alias("n_terms"), F.explode("items").alias("term"))
    counts = materialize(terms.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")), "term-df")
    sums = [(r["field"], r["total"]) for r in counts.groupBy("field").agg(F.sum("df").alias("total")).collect()]
    counts = counts.where(F.col("df") >= min_df)
    if not sums:
        sums = [("", 1)]
    total = F.lit(None).cast("double")
    for field, t in sums:
        total = F.when(F.col("field").eqNullSafe(F.lit(field)), F.lit(float(t))).otherwise(total)
    floor = {f: max(1.0, t * hot_share) for f, t in sums}
    cut = F.lit(None).cast("double")
    for field, least in floor.items():
        cut = F.when(F.col("field").eqNullSafe(F.lit(field)), F.lit(least)).otherwise(cut)
    key = lambda d: [F.coalesce(d["field"], F.lit("")) == F.coalesce(F.col("cf"), F.lit("")), d["field"].isNull() == F.col("cf").isNull(), d["term"] == F.col("ct")]
    small = counts.select(F.col("field").alias("cf"), F.col("term").alias("ct"), "df")
    bound = sum(t / floor[f] for f, t in sums)
    if bound <= hot_limit:
        heads = F.broadcast(counts.where(F.col("df") > cut).select(F.col("field").alias("cf"), F.col("term").alias("ct"), "df"))
        tails = counts.where(F.col("df") <= cut).select(F.col("field").alias("cf"), F.col("term").alias("ct"), F.col("df").alias("df2"))
        marked = terms.join(heads, key(terms), "left").drop("cf", "ct")
        hot = marked.where("df is not null")
        cold = marked.where("df is null").drop("df")
        rest = cold.join(tails, key(cold)).drop("cf", "ct").withColumnRenamed("df2", "df")
        joined = hot.unionByName(rest.select(hot.columns))
    else:
        joined = terms.join(small, key(terms)).drop("cf", "ct")
    pc = F.col("df") / total
    pd = (1 + mu * pc) / (F.col("n_terms") + mu)
    return joined.select("field", "record_key", "record_id", "term", "df", "n_terms", (pd * F.log(pd / pc)).alias("score"))


def best_terms(scored: DataFrame, max_df: int) -> DataFrame:
    """The terms with the best score of their record, all of them if equal, held by at most ``max_df`` records."""
    top = F.max("score").over(Window.partitionBy("field", "record_id"))
    return scored.withColumn("top", top).where((F.col("score") == F.col("top")) & (F.col("df") <= max_df)).drop("top")
