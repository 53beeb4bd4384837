"""Rules as expressions: where a pattern matches, and what it proposes there.

Spark has no expression for match positions. The text is rewritten with a mark before and
after each match and split at the marks: every second piece is a match, and the lengths of
the pieces before it are its offset. The two mark characters are control characters that text
recovery removes. What a rule proposes is computed on the match alone, with the pattern
less its look-ahead.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import capitalized

OPEN, CLOSE = "\u0001", "\u0002"


def matches(text: Column, pattern: str, flags: str = "(?iU)") -> Column:
    """array<struct<begin, text>>: 0-based offsets of non-overlapping matches that are not empty."""
    pieces = F.split(F.regexp_replace(text, flags + pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,text:string>>").alias("found"), F.lit(False).alias("inside"))

    def step(acc: Column, piece: Column) -> Column:
        found = F.when(acc["inside"], F.concat(acc["found"], F.array(F.struct(acc["at"].alias("begin"), piece.alias("text"))))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(piece)).alias("at"), found.alias("found"), (~acc["inside"]).alias("inside"))

    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def bare(pattern: str) -> str:
    """Without the look-ahead at the end."""
    at = pattern.find("(?=")
    return pattern if at < 0 else pattern[:at]


def folded(text: Column) -> Column:
    """``text`` without case, as patterns that ignore case see it: long s, dotless and dotted i, Kelvin sign are plain letters."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f", "iis"))


def stem(pattern: str) -> str:
    """The longest literal that every match has, in lower case; empty if the pattern has none outside its alternatives."""
    gap = "\0"
    rest = re.sub(r"\\[a-zA-Z][?*+]*|\[[^\]]*\](?:[?*+]|\{[^}]*\})*", gap, bare(pattern)).replace("(?:", "(")
    while group := re.search(r"\(([^()]*)\)([?*]?)", rest):
        inner = gap if "|" in group[1] or group[2] else group[1]
        rest = rest[: group.start()] + inner + rest[group.end() :]
    if "|" in rest:
        return ""
    rest = re.sub(r"\\(.)", r"\1", re.sub(r"(?<!\\)[^\\][?*]|(?<!\\)[.+^$]", gap, rest))
    return max((x.strip().lower() for x in rest.split(gap)), key=len, default="")


def may_match(text: Column, rules: list[tuple[int, str, str, str, float, str]]) -> Column:
    """Whether the text has the stem of a rule, or a match of a rule that has no stem; whatever a rule matches is let through."""

    def any_of(f: Column) -> Column:
        return functools.reduce(operator.or_, [_hit(f, text, r) for r in rules])

    return F.exists(F.array(folded(text)), any_of)


def _hit(fold: Column, text: Column, rule: tuple[int, str, str, str, float, str]) -> Column:
    word = stem(rule[1])
    return fold.contains(word) if word else text.rlike(rule[5] + rule[1])


def proposal(match: Column, pattern: str, to: str, flags: str = "(?iU)") -> Column:
    if to == "@ans":
        return F.concat(F.lit("Ans: "), F.upper(F.substring(match, -1, 1)))
    if to == "@capital":
        return capitalized(match)
    return F.regexp_replace(match, f"{flags}^(?:{bare(pattern)})$".replace("(?:^", "(?:"), to)


def keep_case(match: Column, proposed: Column) -> Column:
    """A capital at the start of the match stays one."""

    def capital(c: Column) -> Column:
        return F.substring(c, 1, 1).rlike(r"\p{Lu}")

    return F.when(capital(match) & (proposed != "") & ~capital(proposed), capitalized(proposed)).otherwise(proposed)


def suggestions(text: Column, shift: Column, line: Column, stage: int, rules: list[tuple[int, str, str, str, float, str]], case: bool = False) -> Column:
    """array<struct<stage, rule, begin, stop, original, proposed, category, confidence, line>> of all rules (number, pattern,
    replacement, category, confidence, flags) whose proposal differs from what is there. A rule runs only where its stem and its pattern are found."""

    def entries(number: int, pattern: str, to: str, category: str, confidence: float, flags: str) -> Column:
        def entry(m: Column) -> Column:
            proposed = proposal(m["text"], pattern, to, flags)
            if case:
                proposed = keep_case(m["text"], proposed)
            begin = shift + m["begin"]
            return F.struct(
                F.lit(stage).alias("stage"), F.lit(number).alias("rule"), begin.alias("begin"), (begin + F.length(m["text"])).alias("stop"), m["text"].alias("original"), proposed.alias("proposed"),
                F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), line.alias("line"),
            )

        return F.transform(matches(text, pattern, flags), entry)

    def of_row(f: Column) -> Column:
        return F.flatten(F.array_compact(F.array(*(F.when(_hit(f, text, r) & text.rlike(r[5] + r[1]), entries(*r)) for r in rules))))

    found = F.element_at(F.transform(F.array(folded(text)), of_row), 1)
    return F.filter(found, lambda s: (s["original"] != s["proposed"]) & s["original"].rlike(r"(?U)\S"))


def applied(text: Column, edits: Column) -> Column:
    """``text`` with the edits (array of structs with begin, stop, proposed) made from the last to the first; an edit outside
    the text is left out, and edits that overlap act on what is there by then."""
    n = F.length(text)
    valid = F.filter(edits, lambda e: (e["begin"] >= 0) & (e["begin"] <= e["stop"]) & (e["stop"] <= n))
    order = F.array_sort(valid, lambda a, b: F.when(a["begin"] > b["begin"], -1).when(a["begin"] < b["begin"], 1).otherwise(0))
    return F.aggregate(order, text, lambda acc, e: F.concat(F.substring(acc, F.lit(1), e["begin"]), e["proposed"], F.substring(acc, e["stop"] + 1, F.length(acc))))
