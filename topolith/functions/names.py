"""Names and short labels of functions, types, calls and files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"()\[\]*, {}"


# ---------------------------------------------------------------- display name


def _outside(text: str, mark: str) -> list[int]:
    """Places of ``mark`` outside every bracket of ``text``."""
    depth, found = 0, []
    for at, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == mark and depth == 0:
            found.append(at)
    return found


def _receiver_end(text: str) -> int:
    depth = 0
    for at, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return at
    return -1


def display_text(name: str) -> str:
    """Readable form: no import path and no package, receivers and type arguments as written."""
    end = _receiver_end(name) if name.startswith("(") else -1
    if end > 1:
        star = "*" if name[1] == "*" else ""
        return f"({star}{display_text(name[1 + len(star) : end])}){name[end + 1 :]}"
    # From the right, so that an open bracket on the left does not hide the path.
    slashes = _outside(name[::-1].translate(str.maketrans("()[]", ")(][")), "/")
    if slashes:
        name = name[len(name) - slashes[0] :]
    dots = _outside(name, ".")
    if dots and not set(name[: dots[0]]) & set("()[]"):
        return name[dots[0] + 1 :]
    return name


def _display(c: Column) -> Column:
    def batch(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else display_text(n))

    return F.pandas_udf(batch, "string")(c)


def display_name(c: Column) -> Column:
    """``display_text`` of a column.  Bracket depth needs Python; plain names stay in the JVM."""
    plain = F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"^[^.]*\.", "")
    return F.when(c.rlike(r"[()\[\]]"), _display(c)).otherwise(plain)


# ---------------------------------------------------------------- join key


def join_name(c: Column) -> Column:
    """Key for matching functions by name: every word between separators loses path and package."""
    words = F.regexp_extract_all(c, F.lit(rf"([{SEPARATORS}]|[^{SEPARATORS}]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"^(\.*)(?:.*[/.])?([^/.]*)$", "$1$2")), "")


def type_name(c: Column) -> Column:
    """A type without package paths; pointers, slices and maps keep their form."""
    return F.regexp_replace(c, r"[\w.-]+/", "")


# ---------------------------------------------------------------- calls


def call_signature(kind: Column, mode: Column, target: Column, recv: Column, method: Column, value_type: Column) -> Column:
    """Name of a call for histograms.

    ``kind`` is Call, Go or Defer; go and defer know neither builtins nor reflection, so these
    come out as dynamic there.
    """
    call = kind == "Call"
    dynamic = F.concat(F.lit("dynamic:"), type_name(value_type))
    name = (
        F.when(mode == "invoke", F.concat(F.lit("invoke:"), type_name(recv), F.lit("."), method))
        .when(mode == "static", target)
        .when(mode == "closure", F.concat(F.lit("closure:"), target))
        .when(call & (mode == "builtin"), F.concat(F.lit("builtin:"), target))
        .when(value_type.isNull(), F.when(call, "call:unknown").otherwise("unknown"))
        .when(call & value_type.contains("reflect.Value"), "reflect:Call")
        .otherwise(dynamic)
    )
    return F.concat(F.when(kind == "Go", "go:").when(kind == "Defer", "defer:").otherwise(""), name)


# Prefixes and names that mark an indirect call.
INDIRECT_PREFIXES = ("dynamic:", "reflect:", "invoke:", "go:dynamic:", "defer:dynamic:")
INDIRECT_NAMES = ("reflect.Call", "reflect.CallSlice", "reflect.MethodByName", "reflect.Method")


def is_indirect(sig: Column) -> Column:
    """Whether a call's target is not statically a named function."""
    return sig.rlike("^(" + "|".join(INDIRECT_PREFIXES) + ")") | sig.isin(*INDIRECT_NAMES)


# ---------------------------------------------------------------- labels


def fuzzy_hash(blocks: Column, loops: Column, branches: Column, params: Column, returns: Column) -> Column:
    """Coarse structure label; binary digits give the integer logarithm exactly."""
    log2 = lambda n: F.length(F.bin(n.cast("long"))) - 1
    b = F.when(blocks > 0, log2(blocks)).otherwise(0)
    br = F.when(branches > 0, log2(branches) + 1).otherwise(0)
    return F.concat(F.lit("B"), b, F.lit("L"), F.least(loops, F.lit(5)), F.lit("BR"), br, F.lit("P"), params, F.lit("R"), returns)


def topology_label(loops: Column, branches: Column, instrs: Column, calls: Column) -> Column:
    """Short text for reports; ``calls`` is the sorted list of distinct call names, at most three are shown."""
    more = F.when(F.size(calls) > 3, F.concat(F.lit(",...("), F.size(calls), F.lit(")"))).otherwise("")
    shown = F.array_join(F.slice(calls, 1, 3), ",")
    label = F.concat(F.lit("L"), loops, F.lit("B"), branches, F.lit("I"), instrs, F.lit("["), shown, more, F.lit("]"))
    return F.when(loops.isNull(), "nil").otherwise(label)


def category_prefix(c: Column) -> Column:
    """First three letters of a category in upper case, as used in signature ids."""
    return F.upper(F.substring(c, 1, 3))


def signature_id(category: Column, unix_seconds: Column, number: Column) -> Column:
    return F.concat_ws("-", F.lit("SFW"), category_prefix(category), unix_seconds, number)


def entropy_key(score: Column, sig_id: Column) -> Column:
    """Fixed-width key that orders by entropy first."""
    return F.format_string("%08.4f:%s", score, sig_id)


def humanize_bytes(n: Column) -> Column:
    """Bytes with a binary unit and one decimal from 1 KiB on."""
    size = n.cast("double")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate("KMGTPE", start=1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", F.bround(size / float(1024**power), 1)), F.lit(f" {unit}B"))).otherwise(out)
    return out


def module_line(text: Column) -> Column:
    """Module path of a module file, null if it has no module line."""
    path = F.regexp_extract(text, r"(?m)^\s*module[ \t]+[\"`]?([^\s\"`/][^\s\"`]*)", 1)
    return F.when(path != "", path)


def suggest(word: Column, known: list[str], most: int = 2) -> Column:
    """The first of ``known`` with the least edit distance, if it is at most ``most``; else null."""
    ranked = F.array(*[F.struct(F.levenshtein(word, F.lit(k)).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(known)])
    best = F.array_min(ranked)
    return F.when(best["d"] <= most, best["k"])
