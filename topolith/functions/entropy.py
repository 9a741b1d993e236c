"""Byte entropy: whole buffers, windows, literals.

Histograms of bytes are the one place where rows would multiply by the length of the text, so the
counting is done on Arrow batches with numpy.  Everything around it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, STRIDE = 256, 128


def entropy_of(data: bytes) -> float:
    """Shannon entropy in bits per byte; 0 for an empty buffer."""
    if not data:
        return 0.0
    n = np.bincount(np.frombuffer(data, dtype=np.uint8))
    p = n[n > 0] / len(data)
    return float(0.0 - (p * np.log2(p)).sum()) + 0.0


def window_entropy_of(data: bytes) -> float:
    """Highest entropy of a 256-byte window, stride 128; the last window may be shorter."""
    if len(data) <= WINDOW:
        return entropy_of(data)
    # A window that starts after the first one to reach the end would lie inside that one.
    starts = range(0, -(-(len(data) - WINDOW) // STRIDE) * STRIDE + 1, STRIDE)
    return max(entropy_of(data[s : s + WINDOW]) for s in starts)


def _each(f: Callable[[bytes], float], c: Column) -> Column:
    """Apply ``f`` to every value of an Arrow batch; null stays null.  The UDF is made on use, as workers import this module too."""

    def batch(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v)).astype("float64")

    return F.pandas_udf(batch, "double")(c)


def _literal_mean(literals: np.ndarray) -> float:
    return float(np.mean([entropy_of((x or "").encode()) for x in literals])) if len(literals) else 0.0


def byte_entropy(data: Column) -> Column:
    return _each(entropy_of, data)


def max_window_entropy(data: Column) -> Column:
    return _each(window_entropy_of, data)


def literal_entropy(literals: Column) -> Column:
    """Mean of the entropies of the literals; 0 for none, a null literal counts as empty."""
    return _each(_literal_mean, literals)


def entropy_class(score: Column) -> Column:
    """LOW below 4, NORMAL below 6.5, HIGH below 7.5, else PACKED."""
    return F.when(score < 4.0, "LOW").when(score < 6.5, "NORMAL").when(score < 7.5, "HIGH").otherwise("PACKED")


def entropy_normalized(score: Column) -> Column:
    return score / 8.0


def entropy_distance(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def within_tolerance(score: Column, signature: Column, tolerance: Column, default: float) -> Column:
    """Entropy band of a signature; a tolerance of 0 (or null) means it was never set."""
    return F.abs(score - signature) <= effective_tolerance(tolerance, default)


def effective_tolerance(tolerance: Column, default: float) -> Column:
    return F.when(F.coalesce(tolerance, F.lit(0.0)) == 0, F.lit(default)).otherwise(tolerance)


def literal_bytes(literals: Column) -> Column:
    """Concatenated UTF-8 bytes of the sorted literals."""
    return F.encode(F.array_join(F.array_sort(F.array_compact(literals)), ""), "UTF-8")


def little_endian_hex(value: Column) -> Column:
    """Bytes of an integer from the lowest up, as hex; no trailing zero bytes, a negative one has all eight.

    Values of 0..255 are one byte.
    """
    digits = F.hex(value.cast("long"))
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    return F.array_join(F.reverse(F.regexp_extract_all(even, F.lit("(..)"), 1)), "")


def utf8_prefix(data: Column, limit: int) -> Column:
    """At most ``limit`` bytes of a text, ending on a whole character; returns a string."""
    raw = F.encode(data, "UTF-8")
    cut = lambda k: F.substring(raw, 1, limit - k)
    whole = F.when(F.octet_length(raw) <= limit, raw)
    for k in range(4):
        if limit - k > 0:
            whole = F.coalesce(whole, F.when(F.is_valid_utf8(cut(k).cast("string")), cut(k)))
    return F.decode(F.coalesce(whole, F.lit(b"")), "UTF-8")
