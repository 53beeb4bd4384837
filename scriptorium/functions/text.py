"""Text expressions: recovery, handwriting correction, tokens. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
HYPHEN = r"(\b[a-zA-Z]{2,})-\s*\n\s*([a-zA-Z]{2,}\b)"
NO_SPACE = r"([a-zA-Z0-9]{2,}[.?!,;:>])([a-zA-Z])"
#: Unicode's white space
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it, and nothing of ``f`` computed that it doesn't come to."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def tokens(c: Column) -> Column:
    """Split at white space, without empty tokens."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def capitalized(c: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, (1 << 31) - 1)))


def letters(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^a-zA-Z]", ""))


def replace_all(c: Column, rules: Iterable[tuple[str, str]], flags: str = "(?iU)") -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, flags + pattern, to)
    return c


def collapse_runs(c: Column) -> Column:
    return replace_all(c, ((r"\.{2,}", "."), (r"\?{2,}", "?"), ("!{2,}", "!"), (",{2,}", ",")), "")


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def joined_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + HYPHEN, "$1$2")


def spaced(c: Column) -> Column:
    return F.regexp_replace(c, NO_SPACE, "$1 $2")


def recovered(c: Column) -> Column:
    """Text recovery; blank texts become empty. A step's pattern runs over a text only if a cheaper test leaves it a chance."""

    def guarded(t: Column, test: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
        return let(t, lambda x: F.when(test(x), step(x)).otherwise(x))

    t = guarded(without_controls(c), lambda x: x.contains("-"), lambda x: F.regexp_replace(x, "(?U)" + HYPHEN.replace("{2,})-", "{2,}+)-"), "$1$2"))
    t = guarded(t, lambda x: x.rlike("[.?!,;:>][a-zA-Z]"), lambda x: F.regexp_replace(x, NO_SPACE.replace("{2,}", "{2,}+"), "$1 $2"))
    t = F.regexp_replace(t, r"(?U)\s++([,.:;?!])", "$1")
    t = guarded(t, lambda x: x.contains("..") | x.contains("??") | x.contains("!!") | x.contains(",,"), collapse_runs)
    t = guarded(t, lambda x: x.contains("  ") | x.contains("\t"), lambda x: F.regexp_replace(x, "[ \t]+", " "))
    return F.when(blank(c), F.lit("")).otherwise(strip(F.array_join(F.transform(F.split(t, "\n", -1), strip), "\n")))


def repairs(c: Column) -> dict[str, Column]:
    """Counters of text recovery."""
    clean = without_controls(c)
    seen = {
        "repaired_hyphens": F.regexp_count(clean, F.lit("(?U)" + HYPHEN)),
        "spacing_fixes": F.regexp_count(joined_hyphens(clean), F.lit(NO_SPACE)),
        "symbol_removals": F.length(c) - F.length(clean),
    }
    return {k: F.when(blank(c), 0).otherwise(v) for k, v in seen.items()}


def handwriting(c: Column) -> Column:
    """Confusions, answer and question labels, noise characters, spaces."""
    t = replace_all(F.coalesce(c, F.lit("")), lx.CONFUSIONS)
    t = F.regexp_replace(t, r"(?U)\bAns[;.]\s*", "Ans: ")
    t = F.regexp_replace(t, r"(?U)\bQ\.\s*(\d+)\s*\.\s*", "Q.$1. ")
    t = F.regexp_replace(t, r"[@~{}\[\]|_]", " ")
    return strip(F.regexp_replace(t, "[ \t]+", " "))


def alternative(c: Column) -> Column:
    """Visually confusable reading of each word: final v as y or w, rn as m. Null without any such word."""

    def other(w: Column) -> Column:
        low = F.lower(w)
        v = low.endswith("v") & (F.length(w) > 2) & ~low.isin("gov", "rev")
        stem = F.substring(w, F.lit(1), F.length(w) - 1)
        return F.when(v, F.concat(stem, F.when(low.endswith("kv"), "y").otherwise("w"))).when(low.contains("rn"), F.regexp_replace(w, "(?i)rn", "m")).otherwise(w)

    words = tokens(c)
    changed = F.exists(words, lambda w: other(w) != w)
    return F.when(changed, F.array_join(F.transform(words, other), " "))


def candidates(c: Column) -> Column:
    """Up to three readings, as array<struct<text, weight>> without repeats."""
    fixed, alt = handwriting(c), alternative(c)

    def entry(text: Column, weight: float) -> Column:
        return F.struct(text.alias("text"), F.lit(weight).alias("weight"))

    more = F.array(
        F.when((fixed != c) & ~blank(c), entry(fixed, 0.92)),
        F.when(alt.isNotNull() & ~blank(c) & (alt != c) & (alt != fixed), entry(alt, 0.85)),
    )
    return F.concat(F.array(entry(c, 1.0)), F.filter(more, lambda x: x.isNotNull()))


def word_set(c: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.split(F.lower(c), r"(?U)\W+"))


def listed(words: Column, wanted: Iterable[str]) -> Column:
    """Number of distinct ``wanted`` words (letters only) in a set from :func:`word_set`."""
    return F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in wanted))))


def words_in(c: Column, words: Iterable[str]) -> Column:
    """Number of distinct listed words (letters only) that occur as whole words."""
    return listed(word_set(c), words)
