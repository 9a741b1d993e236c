"""Text around the audit: prompt payload, reply parsing, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted verdicts, limits and phrases of the output check.
VERDICTS = ("MATCH", "SUSPICIOUS", "LIE")
MOST_EVIDENCE, MOST_MESSAGE, MOST_OPS = 4000, 2000, 10
FORBIDDEN = (
    "ignore previous", "ignore prior", "ignore the above", "ignore all previous",
    "disregard previous", "disregard prior", "disregard the above",
    "system prompt", "system message", "developer message",
    "you are now", "new instructions", "override instructions",
    "begin data", "end data",
)


def collapse_whitespace(c: Column) -> Column:
    """Every run of Unicode white space becomes one blank."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def json_body(reply: Column) -> Column:
    """The JSON inside a chatty reply: a fenced block that parses, else from the first ``{`` to the last ``}``."""
    text = F.btrim(reply, F.lit(" \t\n\r\f\x0b"))
    fence = lambda body: F.btrim(F.regexp_extract(text, rf"(?s)```(?:json)?\s*({body})\s*```", 1), F.lit(" \t\n\r"))
    short, long = fence(".*?"), fence(".*")
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1)).otherwise(text)
    return F.when((short != "") & is_json(short), short).when((long != "") & is_json(long), long).otherwise(braces)


def shorten_message(message: Column) -> Column:
    """Commit messages over 2000 characters are cut and marked."""
    return F.when(F.length(message) > MOST_MESSAGE, F.concat(F.substring(message, 1, MOST_MESSAGE), F.lit("[TRUNCATED]"))).otherwise(message)


def prompt_payload(message: Column, evidence: Column, nonce: Column) -> Column:
    """User part of the audit prompt: JSON between fences that carry a nonce."""
    body = F.to_json(F.struct(shorten_message(message).alias("untrusted_commit_message"), evidence.alias("diff_evidence")))
    return F.concat(F.lit("### BEGIN DATA ["), nonce, F.lit("] ###\n"), body, F.lit("\n### END DATA ["), nonce, F.lit("] ###"))


def reply_text(raw: Column) -> Column:
    """Text of the last assistant or model item of a raw reply.

    ``content`` is a string or a list of parts with ``text``; both are read.
    """
    items = F.from_json(raw, "struct<output:array<struct<role:string,content:string>>>")["output"]
    own = F.filter(items, lambda i: i["role"].isin("assistant", "model"))
    content = F.element_at(F.when(F.size(own) > 0, own), -1)["content"]
    parts = F.from_json(content, "array<struct<text:string>>")
    return F.when(content.startswith("["), F.array_join(F.transform(parts, lambda p: p["text"]), "")).otherwise(content)


def output_fault(verdict: Column, evidence: Column) -> Column:
    """Why an audit reply is refused: verdict, length, control character or phrase; null if it is fine."""
    low = collapse_whitespace(F.lower(evidence))
    phrase = F.get(F.filter(F.array(*[F.lit(p) for p in FORBIDDEN]), lambda p: low.contains(p)), F.lit(0))
    return (
        F.when(~F.upper(F.coalesce(verdict, F.lit(""))).isin(*VERDICTS), "verdict")
        .when(F.length(evidence) > MOST_EVIDENCE, "length")
        .when(evidence.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"), "control")
        .when(phrase.isNotNull(), F.concat(F.lit("phrase:"), phrase))
    )


def listed_ops(ops: Column) -> Column:
    """The first ten operations and how many more there are."""
    shown = F.array_join(F.slice(ops, 1, MOST_OPS), ", ")
    return F.when(F.size(ops) > MOST_OPS, F.concat(shown, F.lit(" (+"), F.size(ops) - MOST_OPS, F.lit(" more)"))).otherwise(shown)


def retry_delay_ms(attempt: Column) -> Column:
    """Backoff before a retry: half a second doubled each time, five seconds at most."""
    return F.least(F.pow(F.lit(2.0), attempt) * 500, F.lit(5000.0)).cast("long")
