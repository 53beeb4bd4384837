"""Proofreading: suggestions with exact offsets, their union, numbering, metrics and application."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import lexicons as lx
from scriptorium.functions import rules as rl
from scriptorium.functions import text as tx
from scriptorium.operators.structure import reconstruct
from scriptorium.sources.scratch import stored

NO_CASE, CASE = "(?iU)", "(?U)"
FIELDS = ("stage", "rule", "begin", "stop", "original", "proposed", "category", "confidence", "line")


def lines_of(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rows (keys, line, shift, body) of the lines of ``text``; shift is a line's offset."""
    whole = F.split(F.col(text), "\n", -1)
    placed = F.aggregate(
        whole,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<shift:int,body:string>>").alias("rows")),
        lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["rows"], F.array(F.struct(a["at"].alias("shift"), x.alias("body")))).alias("rows")),
        lambda a: a["rows"],
    )
    return docs.select(*keys, F.posexplode(placed).alias("line", "row")).select(*keys, (F.col("line") + 1).alias("line"), "row.shift", "row.body")


def _exploded(df: DataFrame, keys: list[str], found: Column) -> DataFrame:
    return df.select(*keys, F.explode(found).alias("s")).select(*keys, *(f"s.{f}" for f in FIELDS))


def contextual(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rules over the whole text."""
    rules = [(k, p, to, c, conf, NO_CASE) for k, (p, to, c, conf) in enumerate(lx.CONTEXT)]
    near = docs.where(rl.may_match(F.col(text), rules))
    return _exploded(near, keys, rl.suggestions(F.col(text), F.lit(0), F.lit(1), 2, rules, case=True))


def line_rules(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rules within lines; headings and separators are left alone."""
    rules = [(k, p, to, c, conf, CASE if c == "Capitalization" else NO_CASE) for k, (p, to, c, conf) in enumerate(lx.LINE_RULES)]
    body = F.col("body")
    own = lines_of(docs, text, keys).where(~tx.blank(body) & ~body.startswith("#") & ~body.startswith("===")).where(rl.may_match(body, rules))
    return _exploded(own, keys, rl.suggestions(body, F.col("shift"), F.col("line"), 3, rules))


def contractions(lines: DataFrame, keys: list[str]) -> DataFrame:
    rules = [(k, p, to, "Punctuation Correction", 0.94, NO_CASE) for k, (p, to) in enumerate(lx.CONTRACTIONS)]
    near = lines.where(rl.may_match(F.col("body"), rules))
    return _exploded(near, keys, rl.suggestions(F.col("body"), F.col("shift"), F.col("line"), 1, rules))


def question_marks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Zero-width insertions after interrogative clauses."""

    def entry(m: Column) -> Column:
        at = F.col("shift") + m["begin"] + F.length(tx.strip(m["text"]))
        return F.struct(
            F.lit(1).alias("stage"), F.lit(200).alias("rule"), at.alias("begin"), at.alias("stop"), F.lit("").alias("original"), F.lit("?").alias("proposed"),
            F.lit("Punctuation Correction").alias("category"), F.lit(0.92).alias("confidence"), F.col("line").alias("line"),
        )

    near = lines.where(F.col("body").rlike("(?iU)" + lx.QUESTION))
    found = F.transform(F.filter(rl.matches(F.col("body"), lx.QUESTION), lambda m: ~tx.strip(m["text"]).endswith("?")), entry)
    return _exploded(near, keys, found)


def _openers(lines: DataFrame, keys: list[str]) -> DataFrame:
    body = F.col("body")
    word, letter = F.regexp_extract(body, "(?iU)" + lx.OPENER, 1), F.regexp_extract(body, "(?iU)" + lx.OPENER, 2)
    length = F.length(word) + 2
    s = F.struct(
        F.lit(1).alias("stage"), F.lit(300).alias("rule"), F.col("shift").alias("begin"), (F.col("shift") + length).alias("stop"), F.substring(body, F.lit(1), length).alias("original"),
        F.concat(tx.capitalized(word), F.lit(", "), letter).alias("proposed"), F.lit("Punctuation Correction").alias("category"), F.lit(0.94).alias("confidence"), F.col("line").alias("line"),
    )
    out = lines.where(body.rlike("(?iU)" + lx.OPENER)).select(*keys, s.alias("s"))
    return out.select(*keys, *(f"s.{f}" for f in FIELDS)).where("original <> proposed")


def punctuation(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Contractions, possessives, question marks, commas after openers, and periods between merged sentences."""
    body = F.col("body")
    own = lines_of(docs, text, keys).where(~tx.blank(body) & ~body.startswith("#") & ~body.startswith("|") & ~body.startswith("==="))
    possessive = [(100, lx.POSSESSIVE, "$1's", "Punctuation Correction", 0.92, NO_CASE)]
    boundary = [(400, lx.BOUNDARY, "$1. $2", "Punctuation Correction", 0.88, CASE)]
    out = contractions(own, keys)
    for rules in (possessive, boundary):
        near = own.where(rl.may_match(body, rules) & body.rlike(rules[0][5] + rules[0][1]))
        out = out.unionByName(_exploded(near, keys, rl.suggestions(body, F.col("shift"), F.col("line"), 1, rules)))
    return out.unionByName(question_marks(own, keys)).unionByName(_openers(own, keys))


def spelling(docs: DataFrame, text: str, keys: list[str], vocabulary: DataFrame) -> DataFrame:
    """Words of four letters or more that ``vocabulary`` (word, frequency) lacks, with its most frequent word one edit away.

    Candidates meet at a shared form with one letter deleted, so both sides are joined by equality.
    """
    known = vocabulary.select(F.lower("word").alias("known"), "frequency")
    own = lines_of(docs, text, keys)
    found = F.filter(rl.matches(F.col("body"), r"\b[A-Za-z]{4,}\b", CASE), lambda m: m["text"].rlike("^[a-z]"))
    words = own.select(*keys, "line", "shift", F.explode(found).alias("m")).select(*keys, "line", (F.col("shift") + F.col("m.begin")).alias("begin"), F.col("m.text").alias("original"))
    unknown = words.select(F.lower("original").alias("w")).distinct().join(known, F.col("w") == F.col("known"), "left_anti")

    def deletions(c: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return F.array_distinct(F.concat(F.array(c), cut))

    a = unknown.select("w", F.explode(deletions(F.col("w"))).alias("form"))
    b = known.select("known", "frequency", F.explode(deletions(F.col("known"))).alias("form"))
    near = a.join(b, "form").where(F.levenshtein("w", "known") == 1)
    best = near.groupBy("w").agg(F.min_by("known", F.struct((-F.col("frequency")).alias("less"), "known")).alias("proposed"))
    out = words.join(best, F.lower("original") == F.col("w"))
    return out.select(
        *keys, F.lit(3).alias("stage"), F.lit(500).alias("rule"), "begin", (F.col("begin") + F.length("original")).alias("stop"), "original", "proposed",
        F.lit("Spelling Correction").alias("category"), F.lit(0.82).alias("confidence"), "line",
    )


def from_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Suggestions from recognition candidates (original, start_offset, end_offset, candidates: array<struct<text, confidence>>)."""
    top = F.get("candidates", F.lit(0))
    ok = (F.col("original") != "") & (F.col("start_offset") >= 0) & (F.col("end_offset") > F.col("start_offset")) & (top["text"] != "") & (F.lower(top["text"]) != F.lower("original"))
    return candidates.where(ok).select(
        *keys, F.lit(4).alias("stage"), F.lit(0).alias("rule"), F.col("start_offset").alias("begin"), F.col("end_offset").alias("stop"), "original", top["text"].alias("proposed"),
        F.lit("OCR Multi-Candidate Selection").alias("category"), F.coalesce(top["confidence"], F.lit(0.85)).alias("confidence"), F.lit(1).alias("line"),
    )


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds target_text, the text that suggestions refer to, beside the columns of reconstruction.

    The rows are stored: some eighty rules refer to target_text, and none should carry how it came about.
    """
    out = reconstruct(docs, text).withColumn("__clean", tx.recovered(F.col("recon_text")))
    clean = F.col("__clean")
    return stored(out.withColumn("target_text", F.when(tx.blank(clean), F.col("recon_text")).otherwise(clean)).drop("__clean"), "prepared")


def suggest(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), vocabulary: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """All suggestions of the documents, numbered by offset: keys, suggestion_id, begin, stop, original, proposed, category,
    confidence, line, offset_space.

    Stages come in the order reconstruction, punctuation, context, lines, candidates; of suggestions with the same
    start the first stays. Those of reconstruction refer to the raw text, all others to target_text.
    """
    return suggest_prepared(prepared(docs, text), list(keys), vocabulary, candidates)


def suggest_prepared(own: DataFrame, keys: list[str], vocabulary: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """The suggestions of documents from :func:`prepared`."""
    recon = own.select(*keys, F.explode("recon_edits").alias("e")).select(
        *keys, F.lit(0).alias("stage"), F.col("e.rule").alias("rule"), "e.begin", "e.stop", "e.original", "e.proposed", F.lit("Document Reconstruction").alias("category"), "e.confidence", F.lit(1).alias("line")
    )
    parts = [recon, punctuation(own, "target_text", keys), contextual(own, "target_text", keys), line_rules(own, "target_text", keys)]
    if vocabulary is not None:
        parts.append(spelling(own, "target_text", keys, vocabulary))
    if candidates is not None:
        parts.append(from_candidates(candidates, keys))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return numbered(first_per_start(every, keys), keys)


def first_per_start(suggestions: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "begin").orderBy("stage", "rule", "stop")
    return suggestions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def numbered(suggestions: DataFrame, keys: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("begin"))
    space = F.when(F.col("stage") == 0, "raw").otherwise("target")
    return suggestions.withColumn("offset_space", space).withColumn("suggestion_id", F.concat(F.lit("sug_"), n)).drop("stage", "rule")


def metrics(suggestions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts by kind; some categories only count in the total."""
    c = F.col("category")
    return suggestions.groupBy(*keys).agg(
        F.count_if(c == "Spelling Correction").alias("spelling_errors"),
        F.count_if(c.isin("Grammar Correction", "Sentence Structure")).alias("grammar_errors"),
        F.count_if(c == "Missing Word").alias("missing_words"),
        F.count_if(c.isin("Punctuation Improvement", "Capitalization")).alias("punctuation_corrections"),
        F.count_if(c == "Contextual Substitution").alias("contextual_substitutions"),
        F.count(F.lit(1)).alias("total_suggestions"),
    )


def apply(docs: DataFrame, text: str, accepted: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds corrected_text: ``text`` with the accepted suggestions (keys, begin, stop, proposed)."""
    edits = accepted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("begin", "stop", "proposed"))).alias("__edits"))
    out = docs.join(edits, list(keys), "left")
    return out.withColumn("corrected_text", F.when(F.col("__edits").isNull(), F.col(text)).otherwise(rl.applied(F.col(text), F.col("__edits")))).drop("__edits")


def analyze(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), **more) -> tuple[DataFrame, DataFrame]:
    """(documents with target_text and corrected_text, suggestions): the preview applies all but reconstructions of 0.70 or more."""
    own = prepared(docs, text)
    found = stored(suggest_prepared(own, list(keys), **more), "suggestions")
    chosen = found.where("category <> 'Document Reconstruction' AND confidence >= 0.70")
    return apply(own, "target_text", chosen, keys), found


def pending(suggestions: DataFrame, decided: DataFrame, keys: tuple[str, ...] = ("doc_id",), category: str = "all", search: str = "") -> DataFrame:
    """Suggestions neither accepted nor rejected (``decided``: keys, suggestion_id), of a category, with a substring in one of three fields."""
    out = suggestions.join(decided, [*keys, "suggestion_id"], "left_anti")
    if category != "all":
        out = out.where(F.col("category") == category)
    if search:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", "original", "proposed", "category")), F.lit(search.lower())))
    return out


def quality_score(pending_count: Column) -> Column:
    return F.when(pending_count == 0, 100).otherwise(F.greatest(F.lit(50), F.floor(100 - pending_count * 3.5 + 0.5))).cast("int")


def decide(accepted: Column, rejected: Column, accept: Column, reject: Column) -> tuple[Column, Column]:
    """Accepted and rejected ids after accepting some and rejecting some others."""
    return F.array_except(F.array_union(accepted, accept), reject), F.array_except(F.array_union(rejected, reject), accept)


def accept_confident(suggestions: DataFrame, accepted: DataFrame, keys: tuple[str, ...] = ("doc_id",), least: float = 0.80) -> DataFrame:
    """Accepted ids together with all of ``least`` confidence or more."""
    return suggestions.where(F.col("confidence") >= least).select(*keys, "suggestion_id").union(accepted.select(*keys, "suggestion_id")).distinct()


def dirty(text: Column, saved: Column) -> Column:
    """Whether a text has changed since it was saved."""
    return ~text.eqNullSafe(saved)


def history(actions: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """State after each action (keys, order, action: push, undo or redo; text of a push): adds place, the position in the history, and
    current, the text there. A push after undos cuts off what was undone; undo at the first text and redo at the last do nothing.

    Texts begin with the first push at place 0; before it place is -1 and current null. Actions are sorted by key and order (equal orders by
    action and text) and read once as they come; of a user's history only the numbers of the pushes in it are held, eight bytes each, and
    texts are joined by them.
    """
    keys = list(keys)
    names = [f"k{i}" for i in range(len(keys))]
    own = actions.select(F.struct(*(F.col(c).alias(n) for c, n in zip(keys, names, strict=True))).alias("key"), F.col(order).cast("long").alias("o"), F.col("action").alias("a"), F.col("text").alias("t"))
    dealt = own.repartition("key").sortWithinPartitions("key", "o", "a", "t")
    schema = T.StructType([*dealt.schema.fields, T.StructField("n", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("source", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = None
        stack, at, n = array("q"), -1, 0
        for b in batches:
            out: list[tuple] = []
            for own_key, action in zip(b.column("key").to_pylist(), b.column("a").to_pylist(), strict=True):
                if n == 0 or own_key != key:
                    key, stack, at, n = own_key, array("q"), -1, 0
                n += 1
                if action == "push":
                    del stack[at + 1 :]
                    stack.append(n)
                    at += 1
                elif action == "undo" and at > 0:
                    at -= 1
                elif action == "redo" and at < len(stack) - 1:
                    at += 1
                out.append((n, at, stack[at] if at >= 0 else None))
            if out:
                number, place, source = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int64()), pa.array(place, pa.int32()), pa.array(source, pa.int64())], names=[*b.schema.names, "n", "place", "source"])

    done = stored(dealt.mapInArrow(run, schema), "history")
    texts = done.where("a = 'push'").select(F.col("key").alias("of"), F.col("n").alias("pushed"), F.col("t").alias("current"))
    out = done.join(texts, (F.col("key") == F.col("of")) & (F.col("source") == F.col("pushed")), "left")
    return out.select(*(F.col(f"key.{n}").alias(c) for c, n in zip(keys, names, strict=True)), F.col("o").alias(order), "place", "current")
