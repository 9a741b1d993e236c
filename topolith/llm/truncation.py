"""Text cut off by field limits: length hazards, then incomplete endings.

1. Per source and unit (characters, UTF-8 bytes, characters modulo a block size) the discrete
   hazard of ending at a length is computed by window functions and tested against the
   hazards of the neighbouring lengths.  The Chernoff bound of the binomial tail serves as p-value
   (it is never too small), with Benjamini-Hochberg control per source and unit.
2. An ending model says how much likelier an ending is for a cut text than for a whole one.  It
   needs no labels.  How often words and word pairs occur, and how often a break follows, is counted over
   all texts; the weights are fitted on a bounded sample of whole texts and the same texts cut at random, and the
   scores are calibrated by those of all texts.
3. A text is cut if the odds of its ending times the prior odds exceed one.  The prior at a significant length is the
   share of texts there beyond what the neighbours explain, or the most likely share of cut endings there if that is less, as stock
   answers have lengths of their own too.  Elsewhere (transfers broken off anywhere) it is the most likely share of the source.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialize

# Sizes of transfer blocks that are tested: the powers of two, and 1, 2 and 5 times the powers of ten.
BLOCKS = tuple(sorted([1 << k for k in range(7, 17)] + [m * 10**k for k in range(2, 5) for m in (1, 2, 5)]))
DIMS = 1 << 18
KEY_SHARE = 2e-6  # words and pairs with at least this share of all counts are kept, half a million at most
TOKEN = re.compile(r"[^\W_]+(?:_[^\W_]+)*")
WORDS = re.compile(rf"({TOKEN.pattern})")
BREAK = re.compile(r"[.!?:;\n]")


# ---------------------------------------------------------------- hazards


def length_hazards(lengths: DataFrame, reach: int = 15) -> DataFrame:
    """Hazard of every (source, unit, len) against its neighbours.

    ``lengths``: ``source, unit, len, n``.  Returns also ``at_risk, expected, p``.
    ``expected`` is what the ``reach`` lengths on either side suggest, plus a half.  Where the neighbours themselves scatter
    more than chance, as among one-line answers, the evidence is divided by their spread (mean squared deviation over expectation).
    """
    by = Window.partitionBy("source", "unit").orderBy("len")
    near = by.rangeBetween(-reach, reach)
    risk = lengths.withColumn("at_risk", F.sum("n").over(by.rowsBetween(0, Window.unboundedFollowing)))
    rate = (F.sum("n").over(near) - F.col("n") + 0.5) / (reach * (F.max("at_risk").over(near) + F.min("at_risk").over(near)))
    q, h = F.col("rate"), F.col("n") / F.col("at_risk")
    r = risk.withColumn("rate", F.least(rate, F.lit(1.0))).withColumn("expected", F.col("at_risk") * q)
    off = F.pow(F.col("n") - F.col("expected"), F.lit(2)) / F.col("expected")
    r = r.withColumn("off", off).withColumn("spread", F.greatest(F.lit(1.0), (F.sum("off").over(near) - F.col("off")) / (2 * reach)))
    other = F.when(h < 1, (1 - h) * F.log((1 - h) / (1 - q))).otherwise(0.0)
    kl = F.when((h > q) & (q < 1), h * F.log(h / q) + other).otherwise(0.0)
    return r.select("source", "unit", "len", "n", "at_risk", "expected", F.exp(-F.col("at_risk") * kl / F.col("spread")).alias("p"))


def significant_lengths(hazards: DataFrame, fdr: float = 0.001) -> DataFrame:
    """Lengths whose hazard stands out, with ``share``, the part of their texts the neighbours don't explain."""
    by = Window.partitionBy("source", "unit")
    ranked = hazards.withColumn("rank", F.row_number().over(by.orderBy("p", "len"))).withColumn("tests", F.count(F.lit(1)).over(by))
    last = F.max(F.when(F.col("p") <= fdr * F.col("rank") / F.col("tests"), F.col("rank"))).over(by)
    kept = ranked.withColumn("last", last).where(F.col("rank") <= F.col("last"))
    return kept.select("source", "unit", "len", "n", "expected", "p", (1 - F.col("expected") / F.col("n")).alias("share"))


# ---------------------------------------------------------------- endings


def keys_of(text: str, breaks: dict[str, bool]) -> tuple[list[str], list[str]]:
    """All words and word pairs of a text, and those of them that a break follows; ``breaks`` remembers what is known of gaps.

    The last word is left out, as what follows it is unknown.
    """
    parts = WORDS.split(_mask(text.lower()))  # gap, word, gap, ..., word, gap
    words, gaps = parts[1:-2:2], parts[2:-2:2]
    for g in set(gaps):
        if g not in breaks:
            breaks[g] = bool(BREAK.search(g))
    stops = [breaks[g] for g in gaps]
    before = ["", *("" if stop else w for w, stop in zip(words, stops))]
    pairs = [f"{p} {w}" for p, w in zip(before, words)]
    return words + pairs, [*compress(words, stops), *compress(pairs, stops)]


@dataclass
class Lexicon:
    """How often words and word pairs stand before more text or before a break."""

    word: dict[str, int] = field(default_factory=dict)
    brk: dict[str, int] = field(default_factory=dict)
    prefix: Counter = field(default_factory=Counter)

    def close(self) -> Lexicon:
        for w, c in self.word.items():
            head, _, tail = w.rpartition(" ")
            for k in range(1, len(tail)):
                self.prefix[(head + " " if head else "") + tail[:k]] += c
        return self

    def state(self, key: str) -> str:
        n = self.word.get(key, 0)
        if not n:
            return "part" if self.prefix.get(key, 0) else "new"
        odds = math.log((self.brk.get(key, 0) + 0.5) / (n - self.brk.get(key, 0) + 0.5))
        held = self.prefix.get(key, 0) > n
        return f"{max(-5, min(5, round(odds)))}{'p' if held else ''}"


def lexicon(texts: DataFrame, least: int = 3) -> Lexicon:
    """Counts over all ``texts(text)``, combined in each task and then by key.

    Keys below ``KEY_SHARE`` of all counts, or below ``least``, are left out, so the driver gets at most 1 / KEY_SHARE keys.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        b: Counter = Counter()

        def rows() -> pd.DataFrame:
            out = pd.DataFrame({"key": list(n), "n": list(n.values()), "b": [b[k] for k in n]}).astype({"key": "str", "n": "int64", "b": "int64"})
            n.clear()
            b.clear()
            return out

        breaks: dict[str, bool] = {}
        for batch in batches:
            for text in batch["text"]:
                keys, stopped = keys_of(text, breaks)
                n.update(keys)
                b.update(stopped)
                if len(n) > 300_000:
                    yield rows()
                if len(breaks) > 100_000:
                    breaks.clear()
        yield rows()

    counts = texts.select("text").mapInPandas(count, "key string, n long, b long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    counts = materialize(counts, "lexicon")
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.where(F.col("n") >= max(least, math.ceil(total * KEY_SHARE))).toPandas()
    return Lexicon(dict(zip(kept["key"], kept["n"].tolist())), dict(zip(kept["key"], kept["b"].tolist()))).close()


def _mask(word: str) -> str:
    return re.sub(r"\d+", "0", word)


def ending_features(text: str, lex: Lexicon) -> list[int]:
    """Hashed features of the end of a text; the whole text is read for open code and markup."""
    end = text.rstrip()
    low = re.sub(r"\d+", "0", end[-200:].lower())
    out = [f"s{k}:{low[-k:]}" for k in range(1, 9)]
    words = [_mask(m.group()) for m in TOKEN.finditer(low)]
    last, two = (words[-1], words[-2:]) if words else ("", [])
    tail = low[low.rfind(last) + len(last) :] if last else low
    close = re.sub(r"\w", "a", tail)[-4:]
    out += [f"t:{close}", f"w1:{last}|{close}", f"w2:{' '.join(two)}|{close}", f"w3:{' '.join(words[-3:])}|{close}"]
    line = end.rsplit("\n", 1)[-1]
    part = re.split(r"(?<=[.!?])\s", line)[-1]
    heads = [_mask(m.group().lower()) for m in TOKEN.finditer(part)]
    n = len(heads)
    alone = lex.state(last)
    joint = lex.state(" ".join(two)) if len(two) == 2 and n > 1 else "start"
    out += [f"l1:{alone}|{close}", f"l2:{joint}|{close}", f"l12:{alone}|{joint}|{close}"]
    head = " ".join(heads[:2])
    out += [f"h:{head}", f"h1:{heads[0] if heads else ''}|{min(n, 12)}", f"h2:{head}|{min(n, 8)}|{alone}", f"n:{min(n, 20)}|{close}"]
    out.append("lead:" + re.sub(r"[^\W\d_]+", "a", part[:6]) + f"|{close}")
    above = end[: len(end) - len(line)].rstrip("\n")[-1:]
    gap = end[: len(end) - len(line)][-2:]
    out.append(f"up:{gap!r}|{above if not above.isalnum() else 'a'}|{min(n, 4)}|{'p' if close else 'x'}")
    fence = end.count("```") % 2
    tags = tuple(min(2, max(-1, end.count(f"<{t}") - end.count(f"</{t}"))) for t in ("pre", "code", "a ", "b", "p", "blockquote", "ul", "li"))
    ticks = line.count("`") % 2 if not fence else 0
    out += [f"fence:{fence}", f"tags:{tags}", f"ticks:{ticks}", f"paren:{min(2, max(-1, line.count('(') - line.count(')')))}", f"quote:{line.count(chr(34)) % 2}"]
    block = end.rsplit("\n\n", 1)[-1]
    code = fence or tags[0] > 0 or line.startswith(("    ", "\t"))
    depth = block.count("{") - block.count("}")
    out += [f"code:{bool(code)}|{min(3, max(-1, depth))}", f"codew:{bool(code)}|{last}|{close}", f"codel:{bool(code)}|{' '.join(heads[:1])}|{min(n, 8)}"]
    url = re.search(r"https?:?/?/?\S*$|www\.\S*$|(?<=\s)ht?t?p?$", end)
    if url:
        shape = re.sub(r"[a-z]+", "a", re.sub(r"\d+", "0", url.group().lower().replace("https", "http")))
        body = re.sub(r"\d+", "0", url.group().lower())
        out += ["url:" + shape, "urlend:" + body.rsplit(".", 1)[-1], f"urldepth:{body.count('/')}|{body[-1:]}"]
    if text != end:
        out.append("space:" + repr(text[len(end) :][:2]))
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "replace")) % DIMS for x in out]


@dataclass
class EndingModel:
    """Logistic regression over hashed ending features, and its scores of held-out texts cut at random."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    cut_scores: np.ndarray = field(default_factory=lambda: np.empty(0))

    def score(self, text: str) -> float:
        return float(self.weights[ending_features(text, self.lexicon)].sum() + self.bias)


def at_seam(part: str, rest: str) -> bool:
    """Whether a cut falls between sentences or lines of prose, where nothing is broken off."""
    if part.count("```") % 2 or part.count("<code>") > part.count("</code>"):
        return False
    done = part.rstrip()
    if done[-1:] in ".!?" and (part != done or rest[:1].isspace()):
        return True
    return rest[:1] == "\n" or part[-1:] == "\n"


def _examples(texts: list[str], lex: Lexicon, cuts: int, rng: np.random.Generator) -> tuple[list[list[int]], np.ndarray]:
    """Features of whole texts (0) and of the same texts cut at random (1), cuts at a seam (``at_seam``) left out.

    A few of the cuts get the ellipsis that some exporters put in place of the rest.
    """
    rows, label = [], []
    for t in texts:
        rows.append(ending_features(t, lex))
        label.append(0.0)
        if len(t) < 40:
            continue
        for _ in range(cuts):
            at = int(rng.integers(20, len(t)))
            part = t[:at]
            if at_seam(part, t[at:]):
                continue
            draw = rng.random()
            if draw < 0.18:
                part = part[:-3] + "..." if draw < 0.09 else part[:-1] + "…"
            rows.append(ending_features(part, lex))
            label.append(1.0)
    return rows, np.array(label)


def fit_endings(texts: list[str], lex: Lexicon, cuts: int = 2, epochs: int = 6, seed: int = 5) -> EndingModel:
    """Fit on four fifths of the texts, classes weighted alike, and score the rest cut at random."""
    rng = np.random.default_rng(seed)
    held = len(texts) // 5
    rows, y = _examples(texts[held:], lex, cuts, rng)
    if not len(rows) or y.min() == y.max():
        return EndingModel(lex, np.zeros(DIMS, dtype=np.float32), -20.0)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ptr = np.cumsum([0] + [len(r) for r in rows[:-1]])
    flat = np.array([c for r in rows for c in r], dtype=np.int64)
    length = np.diff(np.append(ptr, len(flat)))
    w, g2, b = np.zeros(DIMS), np.full(DIMS, 1e-8), 0.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            idx = np.concatenate([flat[ptr[i] : ptr[i] + length[i]] for i in pick])
            owner = np.repeat(np.arange(len(pick)), length[pick])
            z = np.bincount(owner, w[idx], len(pick)) + b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            grad = np.bincount(idx, err[owner], DIMS)
            seen = np.unique(idx)
            g = grad[seen] + 1e-6 * w[seen]
            g2[seen] += g * g
            w[seen] -= 0.1 * g / np.sqrt(g2[seen])
            b -= 0.05 * err.sum()
    model = EndingModel(lex, w.astype(np.float32), float(b))
    rows, y = _examples(texts[:held], lex, cuts, rng)
    model.cut_scores = np.array([w[r].sum() + b for r, cut in zip(rows, y) if cut])
    return model


BINS = 80  # scores are counted in steps of a quarter, from -20 to 20


def calibrated(seen: np.ndarray, cut_scores: np.ndarray) -> np.ndarray:
    """Log odds of a cut for every bin of scores, rising, from the bin counts of unlabelled texts and the scores of cut ones.

    The unlabelled texts hold a share of cut ones, so the model, fitted as if they were whole, is too timid where it is surest.  Beyond
    the median score of the cut texts the whole ones have died out, so the share is the ratio of both distributions' tails
    there.  What is left of the unlabelled texts without that share are the whole ones.
    """
    cut = np.bincount(np.clip(np.round(cut_scores * 4), -BINS, BINS).astype(int) + BINS, minlength=2 * BINS + 1)
    f1, f = (cut + 1e-3) / (cut.sum() + 1e-3 * len(cut)), (seen + 1e-3) / (seen.sum() + 1e-3 * len(seen))
    tail1, tail = f1[::-1].cumsum()[::-1], f[::-1].cumsum()[::-1]
    median = int(np.flatnonzero(tail1 >= 0.5)[-1])
    share = float(tail[median] / tail1[median])
    whole = np.maximum(f - share * f1, 0.5 / max(1, seen.sum())) / (1 - share) if share < 1 else f
    # Pool adjacent bins until the odds rise with the score.
    blocks: list[list[float]] = []
    for a, b in zip(f1, whole):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a2, b2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), math.log(a / b)) for a, b, n in blocks])


def score_endings(texts: DataFrame, model: EndingModel) -> DataFrame:
    """``texts`` (with ``doc_id, source, chars, bytes, text``) scored: ``ending`` is the log odds of a cut."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            out = batch[["doc_id", "source", "chars", "bytes"]].copy()
            out["ending"] = [m.score(t) for t in batch["text"]]
            yield out

    return texts.select("doc_id", "source", "chars", "bytes", "text").mapInPandas(score, "doc_id long, source string, chars int, bytes int, ending double")


# ---------------------------------------------------------------- both


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, chars, bytes, tail) of the non-blank texts: all that limits need, without the texts.

    A null source is ''; ``tail`` are the last 12 characters.
    """
    lang = F.lower(F.trim(F.coalesce("lang", F.lit("")))) if "lang" in docs.columns else F.lit("")
    return docs.where(_filled()).select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), lang.alias("lang"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.right("text", F.lit(12)).alias("tail"),
    )


def _filled() -> Column:
    return F.col("text").rlike(r"(?U)\S")


def _residue(block: Column) -> Column:
    """A length modulo a block size, moved so that the border of the block lies in the middle and has neighbours on both sides."""
    return F.pmod(F.col("len") + F.floor(block / 2).cast("int"), block)


def find_limits(sizes: DataFrame, fdr: float = 0.001) -> DataFrame:
    """Significant lengths per source and unit (see ``significant_lengths``), of ``measured`` texts.

    Texts with the same last 12 characters count once per length: a limit cuts at random places, while
    copies and stock phrases of one length all end alike.  Blocks are counted from the table of lengths, without
    the lengths that are significant by themselves.
    """
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("len"))))
    ends = sizes.select("source", "tail", unit.alias("u")).select("source", "tail", "u.*").distinct()
    counts = materialize(ends.groupBy("source", "unit", "len").agg(F.count(F.lit(1)).alias("n")), "lengths")
    single = materialize(significant_lengths(length_hazards(counts), fdr), "single-limits")
    rest = counts.where("unit = 'chars'").join(single, ["source", "unit", "len"], "left_anti")
    rest = rest.select("source", "len", "n", F.explode(F.array(*[F.lit(b) for b in BLOCKS])).alias("b")).where(F.col("len") > F.floor(F.col("b") / 2))
    blocks = rest.select("source", F.concat(F.lit("chars%"), "b").alias("unit"), _residue(F.col("b")).cast("int").alias("len"), "n").groupBy("source", "unit", "len").agg(F.sum("n").alias("n"))
    found = significant_lengths(length_hazards(blocks), fdr)
    # The border of a block is its middle residue.
    return single.unionByName(found.where(F.col("len") == F.floor(F.regexp_extract("unit", r"(\d+)", 1).cast("int") / 2)))


def _at_limits(sizes: DataFrame, limits: DataFrame, slack: int) -> DataFrame:
    """(doc_id, source, unit, len, share) of the texts at a significant length of their source.

    A byte limit drops the rest of a character that does not fit, so it may be up to ``slack`` bytes above the length.  A
    text without a source takes the limits of all.
    """
    blocks = sorted(int(r[0][6:]) for r in limits.where(F.col("unit").startswith("chars%")).select("unit").distinct().collect())  # BLOCKS at most
    entry = lambda unit, length: F.struct(F.lit(unit).alias("unit"), length.cast("int").alias("len"))
    places = [entry("chars", F.col("chars"))] + [entry("bytes", F.col("bytes") + k) for k in range(slack + 1)]
    places += [F.when(F.col("chars") > b // 2, entry(f"chars%{b}", F.pmod(F.col("chars") + b // 2, F.lit(b)))) for b in blocks]
    pooled = limits.groupBy("unit", "len").agg(F.max("share").alias("share")).select(F.lit("").alias("source"), "unit", "len", "share")
    every = limits.where("source <> ''").select("source", "unit", "len", "share").union(pooled)
    rows = sizes.select("doc_id", "source", F.explode(F.array_compact(F.array(*places))).alias("u")).select("doc_id", "source", "u.*")
    return rows.join(every, ["source", "unit", "len"]).select("doc_id", "source", "unit", "len", "share")


def sample_ids(sizes: DataFrame, at: DataFrame, rows: int, most_bytes: int = 48 << 20) -> DataFrame:
    """(doc_id) of about ``rows`` texts away from every limit, ``most_bytes`` in all at most.

    Sources and languages share four fifths by their size and the rest alike; a text is taken if the hash of its id
    is below the rate of its source and language, so the choice is the same however rows are spread.
    """
    strata = materialize(sizes.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")), "strata")
    total = strata.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).first()
    alone = rows * (0.8 * F.col("n") / (total["all"] or 1) + 0.2 / max(1, total["kinds"]))
    rates = strata.select("source", "lang", (alone / F.col("n")).alias("rate"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31)
    picked = sizes.select("doc_id", "source", "lang", "bytes", h.alias("h")).join(rates, ["source", "lang"]).where("h < rate").join(at, "doc_id", "left_anti")
    few = materialize(picked.orderBy("h", "doc_id").limit(2 * rows), "sample")
    running = F.sum("bytes").over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # over 2 * rows rows at most
    return few.withColumn("running", running).where(F.col("running") <= most_bytes).select("doc_id")


def cut_share(endings: DataFrame, *keys: str) -> DataFrame:
    """(keys, cut_share): the most likely share of cut texts in each group, from the log odds ``ending`` of its texts.

    The likelihood of a share q, the product of 1 - q + q * odds, has one maximum, at 0 if the mean of the odds is at most 1.
    Log odds are counted in steps of a quarter from -20 to 20, so a group of any size is a short table.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, gain = pdf["n"].to_numpy(dtype=float), np.exp(pdf["bin"].to_numpy() / 4.0) - 1
        low, high = 0.0, 1.0
        if (n * gain).sum() <= 0:
            high = 0.0
        for _ in range(40):
            q = (low + high) / 2
            low, high = (q, high) if (n * gain / (1 + q * gain)).sum() > 0 else (low, q)
        return pdf[list(keys)].iloc[:1].assign(cut_share=(low + high) / 2)

    step = F.greatest(F.lit(-80), F.least(F.lit(80), F.round(F.col("ending") * 4))).cast("int")
    counts = endings.groupBy(*keys, step.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    schema = ", ".join(f"{k} {endings.schema[k].dataType.simpleString()}" for k in keys) + ", cut_share double"
    return counts.groupBy(*keys).applyInPandas(solve, schema)


def truncated(docs: DataFrame, sample_rows: int = 6000, fdr: float = 0.001, slack: int = 3) -> DataFrame:
    """(doc_id, source, chars, bytes, at_limit, probability) of the texts found to be cut.

    Null and blank texts are no case.  A null source is named '' and takes the limits
    of all sources.  ``sample_rows`` bounds the texts the weights of the ending model are fitted on; everything
    else reads all rows.  ``at_limit`` tells texts at a significant length from those the model alone finds.
    """
    sizes = materialize(measured(docs), "sizes")
    limits = materialize(find_limits(sizes, fdr), "limits")
    hits = materialize(_at_limits(sizes, limits, slack), "at-limit")
    at = hits.select("doc_id").distinct()
    texts = docs.where(_filled()).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), "text")
    chosen = materialize(sample_ids(sizes, at, sample_rows), "sample-ids")
    sample = [r[0] for r in texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text").orderBy("doc_id").select("text").collect()]
    model = fit_endings(sample, lexicon(texts))
    raw = materialize(score_endings(texts, model).withColumn("bin", F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.round(F.col("ending") * 4))).cast("int")), "endings")
    counts = raw.join(at, "doc_id", "left_anti").groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = np.zeros(2 * BINS + 1)
    for k, n in counts:
        seen[k + BINS] = n
    log_odds = calibrated(seen, model.cut_scores) if len(model.cut_scores) else np.full(2 * BINS + 1, -20.0)
    scored = raw.withColumn("ending", F.element_at(F.array(*[F.lit(float(x)) for x in log_odds]), F.col("bin") + BINS + 1))
    at_limit = hits.join(scored.select("doc_id", "ending"), "doc_id")
    real = materialize(cut_share(at_limit, "source", "unit", "len").withColumnRenamed("cut_share", "seen"), "limit-shares")
    # A length alone makes no case: at even odds at most, an ending that is likelier whole than cut is none.
    limit_prior = F.max(F.least("share", "seen", F.lit(0.5))).alias("limit_prior")
    of_text = at_limit.join(real, ["source", "unit", "len"]).groupBy("doc_id").agg(limit_prior)
    base = cut_share(scored.join(at, "doc_id", "left_anti"), "source").withColumnRenamed("cut_share", "prior")
    odds = F.exp(F.least("ending", F.lit(50.0)))
    post = lambda prior: prior * odds / (prior * odds + 1 - prior)
    prior = F.greatest(F.coalesce("limit_prior", F.lit(0.0)), F.coalesce("prior", F.lit(0.0)))
    judged = scored.join(of_text, "doc_id", "left").join(base, "source", "left").withColumn("probability", post(prior))
    return judged.where("probability > 0.5").select("doc_id", "source", "chars", "bytes", F.col("limit_prior").isNotNull().alias("at_limit"), "probability")


def truncation_by_source(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Per source: non-blank texts, cut texts and their share."""
    source = F.coalesce("source", F.lit("")).alias("source")
    all_texts = docs.where(F.col("text").rlike(r"(?U)\S")).select(source).groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    cut = found.groupBy("source").agg(F.count(F.lit(1)).alias("cut"))
    return all_texts.join(cut, "source", "left").select("source", "texts", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("texts")).alias("share"))
