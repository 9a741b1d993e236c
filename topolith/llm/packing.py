"""Filling fixed-capacity containers with texts: best-two-fit.

Texts are sized in tokens of a public tokenizer.  Only a text that alone exceeds the
capacity is split, into full containers and one remainder.  The pieces are dealt by
hash to shards of about ``shard_rows`` pieces, so the work and memory of a task do not grow with
the table and no source, length or author can overload one; each shard is packed
on its own and leaves at most its last few containers badly filled.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize

# Fixed value: the public pre-tokenization pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of the non-blank texts; null, empty and blank texts give no row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) for t in batch["text"]]})

    filled = docs.select("doc_id", "text").where(F.col("text").rlike(r"(?U)\S"))
    return filled.mapInPandas(count, "doc_id long, n_tokens int")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of every item; every size must lie in 1..capacity.

    A bin takes the largest unpacked item that fits until none does.  Then its smallest
    item gives way to the two unpacked items whose sum comes closest to the
    widened gap, if they fill it better.
    """
    order = np.argsort(sizes, kind="stable")
    stock: dict[int, list[int]] = {}
    for at in order[::-1]:
        stock.setdefault(int(sizes[at]), []).append(int(at))
    have = sorted(stock)  # sizes in stock
    bins, left, number = np.full(len(sizes), -1, dtype=np.int64), len(sizes), 0

    def take(size: int) -> int:
        items = stock[size]
        at = items.pop()
        if not items:
            del stock[size]
            have.pop(bisect_left(have, size))
        return at

    def put_back(size: int, at: int) -> None:
        if size not in stock:
            stock[size] = []
            insort(have, size)
        stock[size].append(at)

    while left:
        held: list[tuple[int, int]] = []
        gap = capacity
        while gap and (k := bisect_right(have, gap)):
            size = have[k - 1]
            held.append((size, take(size)))
            gap -= size
        if gap and have:
            least, at = held[-1]  # sizes fall along the bin
            if pair := _best_pair(have, stock, gap + least, least):
                held.pop()
                put_back(least, at)
                held += [(s, take(s)) for s in pair]
        for _, at in held:
            bins[at] = number
        left -= len(held)
        number += 1
    return bins


def _best_pair(have: list[int], stock: dict[int, list[int]], room: int, least: int) -> tuple[int, int] | None:
    """The two stocked sizes with the largest sum in (least, room]."""
    small = np.array(have[: bisect_right(have, room - 1)], dtype=np.int64)
    if not len(small):
        return None
    k = np.searchsorted(small, room - small, side="right") - 1
    # A size may be paired with itself only if two items have it.
    for j in np.flatnonzero((k >= 0) & (small[k] == small)):
        if len(stock[int(small[j])]) < 2:
            k[j] -= 1
    sums = np.where(k >= 0, small + small[k], -1)
    best = int(sums.argmax())
    return (int(small[best]), int(small[k[best]])) if sums[best] > least else None


def pack(sized: DataFrame, containers: list[tuple[str, int]], shard_rows: int = 20_000) -> DataFrame:
    """Assign every text of ``sized`` (doc_id, n_tokens) to containers of each kind.

    ``containers``: (kind, capacity) of a configuration table.  Texts with null or
    no tokens are left out.  Returns one row per piece: ``container_kind,
    capacity, container_id, doc_id, piece, first_token, n_tokens``; container_id is unique
    within its kind.  An unsplit text is piece 0.
    """
    if any(c is None or c < 1 for _, c in containers):
        raise ValueError("capacities must be at least 1")
    rows = sized.where("n_tokens > 0")
    shards = max(1, -(-sized.count() // shard_rows))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("capacity")) for k, c in containers])
    pieces = (
        rows.select("doc_id", "n_tokens", F.explode(kinds).alias("k")).select("doc_id", "n_tokens", "k.*")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1)))
        .withColumn("first_token", F.col("piece") * F.col("capacity"))
        .withColumn("n_tokens", F.least(F.col("capacity"), F.col("n_tokens") - F.col("first_token")))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    )

    def one_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        number = best_two_fit(pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pdf.assign(container_id=(pdf["shard"].to_numpy().astype(np.int64) << 32) + number).rename(columns={"kind": "container_kind"})

    schema = "container_kind string, capacity int, container_id long, doc_id long, piece int, first_token int, n_tokens int"
    columns = [c.split()[0] for c in schema.split(", ")]
    return pieces.groupBy("kind", "capacity", "shard").applyInPandas(lambda pdf: one_shard(pdf)[columns], schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, the least number of containers possible, and the share of space used."""
    tokens = F.sum("n_tokens")
    per = packed.groupBy("container_kind", "capacity", "container_id").agg(tokens.alias("used"), F.count(F.lit(1)).alias("pieces"))
    return per.groupBy("container_kind", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity"))).alias("fill"),
    )


def materialize_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts written once: sizing is the expensive part and is read more than once."""
    return materialize(token_counts(docs, vocabulary), "token-counts")
