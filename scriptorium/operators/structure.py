"""Topics, subjects, line structure and sentence reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.functions import rules as rl
from scriptorium.functions import text as tx


def _best(scores: list[Column], names: list[str]) -> Column:
    """struct<score, name> of the highest score; the first of equal ones."""
    entries = [F.struct((-s).alias("less"), F.lit(k).alias("place"), F.lit(n).alias("name")) for k, (s, n) in enumerate(zip(scores, names, strict=True))]
    return F.array_min(F.array(*entries))


def topic_prior(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds topic, topic_name, topic_confidence: the topic with the most keywords present."""
    c = F.col(text)
    best = _best([tx.listed(F.col("__words"), words.split()) for _, words in lx.TOPICS.values()], list(lx.TOPICS))
    out = docs.withColumn("__words", tx.word_set(c)).withColumn("__best", best).drop("__words").withColumn("__n", -F.col("__best.less"))
    none = F.col("__n") == 0
    names = F.create_map(*(F.lit(x) for k, (n, _) in lx.TOPICS.items() for x in (k, n)))
    topic = F.when(tx.blank(c) | none, "general").otherwise(F.col("__best.name"))
    name = F.when(tx.blank(c), "General Science Notebook").when(none, "General Educational Notebook").otherwise(names[F.col("__best.name")])
    confidence = F.when(tx.blank(c) | none, 0.50).otherwise(F.least(F.lit(0.98), 0.50 + F.col("__n") * 0.08))
    return out.withColumn("topic", topic).withColumn("topic_name", name).withColumn("topic_confidence", confidence).drop("__best", "__n")


def subject(docs: DataFrame, text: str = "text", title: str | None = None, override: str = "Auto") -> DataFrame:
    """Adds subject, subject_name, subject_confidence: title patterns weigh 0.40 each, keywords 0.06 up to 0.50."""
    if override != "Auto":
        return docs.withColumns({"subject": F.lit(override), "subject_name": F.lit(override), "subject_confidence": F.lit(1.0)})
    whole = F.lower(F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")) if title else F.lit(""), F.coalesce(F.col(text), F.lit(""))))
    scores = []
    for _, words, patterns in lx.SUBJECTS.values():
        titles = sum((F.when(F.col("__t").rlike("(?U)" + p), 0.40).otherwise(0.0) for p in patterns), F.lit(0.0))
        scores.append(titles + F.least(F.lit(0.50), tx.listed(F.col("__words"), words.split()) * 0.06))
    out = docs.withColumn("__t", whole).withColumn("__words", tx.word_set(F.col("__t"))).withColumn("__best", _best(scores, list(lx.SUBJECTS))).withColumn("__s", -F.col("__best.less"))
    found = F.col("__s") >= 0.15
    names = F.create_map(*(F.lit(x) for k, (n, _, _) in lx.SUBJECTS.items() for x in (k, n)))
    return out.withColumns(
        {
            "subject": F.when(found, F.col("__best.name")).otherwise("General"),
            "subject_name": F.when(found, names[F.col("__best.name")]).otherwise("General Educational Notebook"),
            "subject_confidence": F.when(found, F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.55), F.col("__s"))), 4)).otherwise(0.50),
        }
    ).drop("__t", "__words", "__best", "__s")


def structure_of(c: Column) -> Column:
    """Structural tag of a line."""
    t = tx.strip(c)
    out = F.when(tx.blank(c), "Text")
    for tag, pattern in lx.STRUCTURES:
        out = out.when(t.rlike("(?iU)" + pattern), tag)
    return out.otherwise("Text")


def heading_fixes(c: Column) -> tuple[Column, Column]:
    """(text with heading spellings corrected, boost of 0.12 for each rule that fires)"""
    boost, t = F.lit(0.0), c
    for pattern, to in lx.HEADINGS:
        boost = boost + F.when(t.rlike("(?iU)" + pattern), 0.12).otherwise(0.0)
        t = F.regexp_replace(t, "(?iU)" + pattern, to)
    return F.when(tx.blank(c), c).otherwise(t), F.when(tx.blank(c), 0.0).otherwise(boost)


def structured_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Adds fixed_text, boost, structure."""
    fixed, boost = heading_fixes(F.col(text))
    return lines.withColumn("fixed_text", fixed).withColumn("boost", F.round(boost, 4)).withColumn("structure", structure_of(F.col("fixed_text")))


def pick_by_structure(lines: DataFrame) -> DataFrame:
    """Adds picked_text: of two or more ``candidates`` (array<struct<text, visual_confidence>>) the one that fits the line's structure best."""
    tag = F.col("structure")

    def score(c: Column) -> Column:
        same = F.when((structure_of(c["text"]) == tag) & (tag != "Text"), 0.15).otherwise(0.0)
        verb = F.when(tag.isin("Activity", "Experiment", "Procedure") & c["text"].rlike(r"(?iU)\b(fill|take|mix|place|add|measure|observe|check)\b"), 0.10).otherwise(0.0)
        return F.coalesce(c["visual_confidence"], F.lit(0.5)) + same + verb

    ranked = F.transform("candidates", lambda c, k: F.struct((-score(c)).alias("less"), k.alias("place"), c["text"].alias("text")))
    best = F.array_min(ranked)
    return lines.withColumn("picked_text", F.when((F.size("candidates") > 1) & (best["less"] < 0), best["text"]).otherwise(F.col("fixed_text")))


def reconstruct(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds topic columns, recon_text, recon_edits (array<struct<rule, begin, stop, original, proposed, confidence>>) and confidences.

    Each rule rewrites its first match in the text that the rules before it left.
    """
    kind = "array<struct<rule:int,begin:int,stop:int,original:string,proposed:string,confidence:double>>"
    begin = F.struct(F.col(text).alias("text"), F.array().cast(kind).alias("edits"))
    rules = [(k, p, to, "", confidence, "(?iU)") for k, (p, to, _, confidence) in enumerate(lx.RECONSTRUCTIONS)]

    def rewritten(state: Column, rule: tuple) -> Column:
        k, pattern, to, _, confidence, flags = rule
        p = flags + pattern

        def edited(x: Column, found: Column) -> Column:
            stop = found["at"] + F.length(found["m"])
            edit = F.struct(F.lit(k).alias("rule"), (found["at"] - 1).alias("begin"), (stop - 1).alias("stop"), found["m"].alias("original"), F.lit(to).alias("proposed"), F.lit(confidence).alias("confidence"))
            new = F.concat(F.substring(x["text"], F.lit(1), found["at"] - 1), F.lit(to), F.substring(x["text"], stop, F.length(x["text"])))
            return F.when((found["at"] > 0) & (found["m"] != to), F.struct(new.alias("text"), F.concat(x["edits"], F.array(edit)).cast(kind).alias("edits"))).otherwise(x)

        def step(x: Column) -> Column:
            found = F.struct(F.regexp_instr(x["text"], F.lit(p)).alias("at"), F.regexp_extract(x["text"], p, 0).alias("m"))
            return F.when(rl.may_match(x["text"], [rule]), tx.let(found, lambda y: edited(x, y))).otherwise(x)

        return tx.let(state, step)

    done = begin
    for rule in rules:
        done = rewritten(done, rule)
    # most texts have no rule's stem, and no rule makes one of nothing
    done = F.when(rl.may_match(F.col(text), rules) & ~tx.blank(F.col(text)), done).otherwise(begin)
    out = topic_prior(docs, text).withColumn("__done", done)
    out = out.withColumns({"recon_text": F.col("__done.text"), "recon_edits": F.col("__done.edits")}).drop("__done")
    boosted = F.col("recon_text")
    for topic, rules in lx.TOPIC_WORDS.items():
        boosted = F.when(F.col("topic") == topic, tx.replace_all(F.col("recon_text"), rules)).otherwise(boosted)
    some = F.size("recon_edits") > 0
    return out.withColumns({"recon_text": boosted, "ocr_confidence": F.lit(0.65), "recon_confidence": F.when(some, 0.96).otherwise(0.82), "final_confidence": F.when(some, 0.94).otherwise(0.85)})
