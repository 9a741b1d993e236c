"""Evaluation texts leaking into training text: size-partitioned MinHash containment.

Every run of ``run`` words of a test item is a query; its domain is the set of its
five-word shingles.  Document texts are the domains that may contain it.  They are partitioned by size: a short text is one
domain, in the partition of its number of shingles; longer ones are cut into
passages of the largest partition, so that each run of ``run`` words lies whole in one.  If a domain holds a query, the
query's minimum under a random hash function is the domain's minimum with probability |query| / |domain|, so each
partition uses as many functions as make a miss rarer than ``miss``.

The items become an index table (key, item_id), a key being a minimum under its function.  A run with
repeated words has fewer shingles and would be missed more often, so its shingles are keys of their own.
The documents are scanned once, however many items there are.  A bitmap of the index keys, of 32 MB at most, goes
to every task; passages with a key in it leave the scan with their words and are joined
with the index by shuffle, then with the items, and verified by exact containment of a run.  The bitmap only saves shuffle:
beyond its size more passages are joined in vain, and none is lost.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
PARTITIONS = (10, 12, 14, 16, 20)  # shingles of a passage, upper ends


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits; case, compatibility forms and format characters do not matter."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _without_format(text))
        text = unicodedata.normalize("NFKC", _without_format(text).casefold())
    else:
        text = text.lower()
    return WORD.findall(text)


def _without_format(text: str) -> str:
    odd = {c for c in set(text) if not c.isascii() and unicodedata.category(c) == "Cf"}
    return text.translate({ord(c): None for c in odd}) if odd else text


class _Hasher:
    """64-bit hashes of words, kept for the words seen so far (at most ``most``)."""

    def __init__(self, most: int = 200_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w.encode())
        return np.fromiter((seen[w] for w in words), dtype=np.uint64, count=len(words))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


class Sizes:
    """Size partitions and hash functions, the same for items and documents."""

    def __init__(self, run: int, miss: float, seed: int = 11):
        self.run, self.query, self.width = run, run - SHINGLE + 1, PARTITIONS[-1]
        self.functions = [1 if n <= self.query else math.ceil(math.log(miss) / math.log(1 - self.query / n)) for n in PARTITIONS]
        rng = np.random.default_rng(seed)
        most = max(self.functions) + 1  # the last one keys single shingles
        self.mul = rng.integers(0, 2**63, most, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, most, dtype=np.uint64)
        self.tag = rng.integers(0, 2**63, most, dtype=np.uint64)

    def minima(self, domains: np.ndarray, count: int) -> np.ndarray:
        """Keys of the rows of shingle hashes under the first ``count`` functions, one column each."""
        out = np.empty((len(domains), count), dtype=np.uint64)
        for k in range(count):
            out[:, k] = (domains * self.mul[k] + self.add[k]).min(axis=1) ^ self.tag[k]
        return out

    def singles(self, shingles: np.ndarray) -> np.ndarray:
        return (shingles * self.mul[-1] + self.add[-1]) ^ self.tag[-1]

    def item_keys(self, words: list[str], hasher: _Hasher) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of all runs of an item: minima, and single shingles of the runs with repeated words."""
        sh = run_hashes(hasher(words), SHINGLE)
        if len(words) < self.run:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        windows = np.lib.stride_tricks.sliding_window_view(sh, self.query)
        ordered = np.sort(windows, axis=1)
        repeated = windows[(ordered[:, 1:] == ordered[:, :-1]).any(axis=1)]
        return np.unique(self.minima(windows, max(self.functions))), np.unique(self.singles(repeated))


PROBES = tuple(np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))  # odd multipliers; the high bits are the place


def bitmap_bits(keys: int) -> int:
    """Size of the bitmap for a number of keys: 64 times as many bits, 2**16 at least and 2**28 (32 MB) at most."""
    return 1 << min(28, max(16, math.ceil(math.log2(max(1, keys) * 64))))


def key_bitmap(index: DataFrame, bits: int) -> np.ndarray:
    """Bitmap with three bits of every key, made in slices of 128 KB by the executors; the driver gets ``bits`` bits at most."""
    slice_bits, shift = min(bits, 1 << 20), np.uint64(64 - int(math.log2(bits)))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([(keys * m) >> shift for m in PROBES])).astype(np.int64)
            yield pd.DataFrame({"slice": (at // slice_bits).astype(np.int32), "at": at % slice_bits})

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(slice_bits, dtype=bool)
        flags[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "bits": [np.packbits(flags).tobytes()]})

    slices = index.select("key").mapInPandas(places, "slice int, at long").groupBy("slice").applyInPandas(mark, "slice int, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for number, raw in slices.collect():
        out[number * slice_bits // 8 : (number + 1) * slice_bits // 8] = np.frombuffer(raw, dtype=np.uint8)
    return out


def in_bitmap(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    shift, hit = np.uint64(64 - int(math.log2(len(bitmap) * 8))), np.ones(keys.shape, dtype=bool)
    for m in PROBES:
        at = (keys[hit] * m) >> shift
        hit[hit] = (bitmap[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
    return hit


def index_items(items: DataFrame, sizes: Sizes) -> DataFrame:
    """(key long, item_id, single boolean): single tells that the key is a shingle of a run with repeated words."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        for batch in batches:
            for item_id, text in zip(batch["item_id"], batch["text"]):
                for single, found in enumerate(sizes.item_keys(words_of(text), hasher)):
                    yield pd.DataFrame({"key": found.view(np.int64), "item_id": np.full(len(found), item_id, dtype=np.int64), "single": bool(single)})

    return items.mapInPandas(keys, "key long, item_id long, single boolean")


def plain_words(items: DataFrame) -> DataFrame:
    """(item_id, words): the words of an item in one string, with a blank at both ends."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "words": [" " + " ".join(words_of(t)) + " " for t in batch["text"]]})

    return items.mapInPandas(join, "item_id long, words string")


def _positives(sizes: Sizes, bitmap: np.ndarray, singles: bool, docs: list[tuple[int, list[str]]], hasher: _Hasher) -> list[tuple[int, int, list[str], np.ndarray]]:
    """(doc_id, at, words, keys) of the passages of a group of documents that have a key in the bitmap."""
    step = sizes.width + SHINGLE - sizes.run
    domains: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for d, (_, words) in enumerate(docs):
        sh = run_hashes(hasher(words), SHINGLE)
        for at in range(0, max(1, len(words) - sizes.run + 1), step):
            part = sh[at : at + sizes.width]
            domains.setdefault(bisect_left(PARTITIONS, len(part)), []).append((d, at, part))
    out = []
    for partition, group in domains.items():
        n = PARTITIONS[partition]
        matrix = np.stack([p if len(p) == n else np.pad(p, (0, n - len(p)), mode="edge") for _, _, p in group])
        keys = sizes.minima(matrix, sizes.functions[partition])
        if singles:
            keys = np.concatenate([keys, sizes.singles(matrix)], axis=1)
        hit = in_bitmap(keys, bitmap)
        for row in np.flatnonzero(hit.any(axis=1)):
            d, at, _ = group[row]
            doc_id, words = docs[d]
            out.append((doc_id, at, words[at : at + step + sizes.run - 1], np.unique(keys[row][hit[row]]).view(np.int64)))
    return out


def leaked(docs: DataFrame, items: DataFrame, run: int = 12, miss: float = 1e-5) -> DataFrame:
    """(doc_id, item_id): the text of the document holds ``run`` consecutive words of the item.

    Null and blank texts match nothing; an item with fewer than ``run`` words cannot be
    found; repeated item ids count as one item with all their texts; rows with a null id are left out.  Whole texts are read.
    """
    if not SHINGLE <= run <= PARTITIONS[-1]:
        raise ValueError("run out of range")
    spark, sizes = docs.sparkSession, Sizes(run, miss)
    wanted = items.select("item_id", "text").where("item_id is not null and text is not null")
    index = materialize(index_items(wanted, sizes).distinct(), "item-index")
    singles = not index.where("single").isEmpty()
    shared = spark.sparkContext.broadcast(key_bitmap(index, bitmap_bits(index.count())))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher()
        for batch in batches:
            found: list[tuple[int, int, list[str], np.ndarray]] = []
            group: list[tuple[int, list[str]]] = []
            held = 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                if len(words) < run:
                    continue
                group.append((doc_id, words))
                held += len(words)
                if held > 50_000:
                    found += _positives(sizes, shared.value, singles, group, hasher)
                    group, held = [], 0
            found += _positives(sizes, shared.value, singles, group, hasher) if group else []
            yield pd.DataFrame(found, columns=["doc_id", "at", "passage", "keys"]).astype({"doc_id": "int64", "at": "int32"})

    texts = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    passages = materialize(texts.mapInPandas(scan, "doc_id long, at int, passage array<string>, keys array<long>"), "passages")
    # Only numbers meet the index; the words of a passage join once per item and not once per key.
    met = passages.select("doc_id", "at", F.explode("keys").alias("key")).join(index, "key").select("doc_id", "at", "item_id").distinct()
    met = met.join(passages.select("doc_id", "at", "passage"), ["doc_id", "at"])
    starts = F.sequence(F.lit(1), F.size("passage") - (run - 1))
    piece = lambda k: F.concat(F.lit(" "), F.array_join(F.slice("passage", k, run), " "), F.lit(" "))
    holds = F.exists(starts, lambda k: F.col("words").contains(piece(k)))
    return met.join(plain_words(wanted), "item_id").where(holds).select("doc_id", "item_id").distinct()
