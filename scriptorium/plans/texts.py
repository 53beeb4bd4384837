"""Queries on text: recovery, handwriting, structure, proofreading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.functions import text as tx
from scriptorium.operators import proofreading as pr
from scriptorium.operators import structure as st
from scriptorium.plans.registry import CORPUS, LINES, corpus, lines, query, quoted, replaced, sql_list, stripped, table, unequal, words_of
from scriptorium.sources import files

RUNS = ((r"\.{2,}", "."), (r"\?{2,}", "?"), ("!{2,}", "!"), (",{2,}", ","))
_C0 = r"regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
_HY, _NS = tx.HYPHEN, tx.NO_SPACE

RECOVERED = f"""
a AS (SELECT *, {_C0} AS c0 FROM corpus),
b AS (SELECT *, regexp_replace(c0, '{_HY}', '\\1\\2', 'g') AS c1, len(regexp_extract_all(c0, '{_HY}')) AS hy FROM a),
c AS (SELECT *, {replaced(f"regexp_replace(regexp_replace(c1, '{_NS}', chr(92) || '1 ' || chr(92) || '2', 'g'), '" + chr(92) + "s+([,.:;?!])', chr(92) || '1', 'g')", RUNS, "g")} AS c2, len(regexp_extract_all(c1, '{_NS}')) AS ns FROM b),
rec AS (SELECT *, CASE WHEN {unequal('text')} THEN '' ELSE {stripped("array_to_string(list_transform(string_split(c2, chr(10)), lambda x: " + stripped("regexp_replace(x, '[ " + chr(92) + "t]+', ' ', 'g')") + "), chr(10))")} END AS recovered_text FROM c)"""


@query(
    f"""WITH {CORPUS}, {RECOVERED}
SELECT doc_id, recovered_text, CASE WHEN {unequal('text')} THEN 0 ELSE hy END AS repaired_hyphens, CASE WHEN {unequal('text')} THEN 0 ELSE ns END AS spacing_fixes,
  CASE WHEN {unequal('text')} THEN 0 ELSE length(text) - length(c0) END AS symbol_removals, length(text) AS original_length, length(recovered_text) AS recovered_length FROM rec"""
)
def tx_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    own = corpus(spark, sf_dir).withColumn("recovered_text", tx.recovered(t))
    return own.select("doc_id", "recovered_text", *(v.alias(k) for k, v in tx.repairs(t).items()), F.length("text").alias("original_length"), F.length("recovered_text").alias("recovered_length"))


@query(f"WITH {CORPUS} SELECT doc_id, {replaced('text', RUNS, 'g')} AS collapsed, len(regexp_extract_all(text, '[.]{{2,}}|[?]{{2,}}|!{{2,}}|,{{2,}}')) AS n_runs FROM corpus")
def tx_collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", tx.collapse_runs(F.col("text")).alias("collapsed"), F.regexp_count("text", F.lit("[.]{2,}|[?]{2,}|!{2,}|,{2,}")).alias("n_runs"))


@query(f"WITH {CORPUS} SELECT doc_id, len(regexp_extract_all(text, '{_NS}')) AS spacing_fixes, length(regexp_replace(text, '{_NS}', '\\1 \\2', 'g')) AS new_length FROM corpus")
def tx_missing_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(_NS)).alias("spacing_fixes"), F.length(tx.spaced(F.col("text"))).alias("new_length"))


def _handwriting(expr: str) -> str:
    t = replaced(expr, lx.CONFUSIONS)
    t = f"regexp_replace(regexp_replace({t}, '\\bAns[;.]\\s*', 'Ans: ', 'g'), '\\bQ\\.\\s*(\\d+)\\s*\\.\\s*', 'Q.\\1. ', 'g')"
    return stripped(f"regexp_replace(regexp_replace({t}, '[@~{{}}\\[\\]|_]', ' ', 'g'), '[ \\t]+', ' ', 'g')")


@query(f"WITH {CORPUS} SELECT doc_id, {_handwriting('text')} AS corrected, {_handwriting('text')} <> text AS changed FROM corpus")
def hw_post_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus(spark, sf_dir).withColumn("corrected", tx.handwriting(F.col("text")))
    return own.select("doc_id", "corrected", (F.col("corrected") != F.col("text")).alias("changed"))


_ALT = f"""array_to_string(list_transform({words_of('text')}, lambda w: CASE WHEN lower(w) LIKE '%v' AND length(w) > 2 AND lower(w) NOT IN ('gov', 'rev')
  THEN substr(w, 1, length(w) - 1) || CASE WHEN lower(w) LIKE '%kv' THEN 'y' ELSE 'w' END WHEN lower(w) LIKE '%rn%' THEN regexp_replace(w, 'rn', 'm', 'gi') ELSE w END), ' ')"""
_ALT_ANY = f"len(list_filter({words_of('text')}, lambda w: (lower(w) LIKE '%v' AND length(w) > 2 AND lower(w) NOT IN ('gov', 'rev')) OR lower(w) LIKE '%rn%')) > 0"


@query(
    f"""WITH a AS (SELECT conv_id, turn, text, {_handwriting('text')} AS fixed, CASE WHEN {_ALT_ANY} THEN {_ALT} END AS alt FROM conversations)
SELECT conv_id, turn, text AS reading, 1.0::DOUBLE AS weight FROM a UNION ALL SELECT conv_id, turn, fixed, 0.92::DOUBLE FROM a WHERE fixed <> text AND NOT ({unequal('text')})
UNION ALL SELECT conv_id, turn, alt, 0.85::DOUBLE FROM a WHERE alt IS NOT NULL AND alt <> text AND alt <> fixed"""
)
def hw_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tx.candidates(F.col("text"))).alias("c"))
    return own.select("conv_id", "turn", F.col("c.text").alias("reading"), F.col("c.weight").alias("weight"))


@query("SELECT md5(text) AS content_hash, count(*) AS n_documents, min(doc_id) AS first_doc_id FROM documents GROUP BY md5(text)")
def io_hash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("content_hash", F.md5("text"))
    once = files.distinct_texts(docs).select("content_hash")
    return docs.join(once, "content_hash").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_doc_id"))


@query(
    f"""SELECT page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS extension, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN ({", ".join(quoted(e) for e in lx.EXTENSIONS)}) AS supported FROM pages"""
)
def io_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.extension(F.col("url")).alias("extension"), files.is_supported(F.col("url")).alias("supported"))


_SPLIT = "string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}_]+')"


def _present(expr: str, words: str) -> str:
    return f"len(list_intersect({sql_list(words.split())}, {_SPLIT.format(expr)}))"


_TOPICS = list(lx.TOPICS)


@query(
    f"""WITH {CORPUS}, n AS (SELECT doc_id, text, {", ".join(f"{_present('text', lx.TOPICS[t][1])} AS {t}" for t in _TOPICS)} FROM corpus),
m AS (SELECT *, greatest({", ".join(_TOPICS)}) AS n FROM n)
SELECT doc_id, CASE WHEN n = 0 THEN 'general' {" ".join(f"WHEN {t} = n THEN '{t}'" for t in _TOPICS)} END AS topic,
  CASE WHEN {unequal('text')} THEN 'General Science Notebook' WHEN n = 0 THEN 'General Educational Notebook' {" ".join(f"WHEN {t} = n THEN {quoted(lx.TOPICS[t][0])}" for t in _TOPICS)} END AS topic_name,
  round(CASE WHEN n = 0 THEN 0.5 ELSE least(0.98, 0.5 + 0.08 * n) END, 6)::DOUBLE AS topic_confidence FROM m"""
)
def rc_topic_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.topic_prior(corpus(spark, sf_dir)).select("doc_id", "topic", "topic_name", F.round("topic_confidence", 6).alias("topic_confidence"))


_SUBJECTS = {f"s{k}": (n, v) for k, (n, v) in enumerate(lx.SUBJECTS.items())}


def _subject_score(v: tuple) -> str:
    titles = " + ".join(f"CASE WHEN regexp_matches(lower(text), {quoted(p)}) THEN 40 ELSE 0 END" for p in v[2])
    return f"{titles} + least(50, 6 * {_present('text', v[1])})"


@query(
    f"""WITH {CORPUS}, n AS (SELECT doc_id, {", ".join(f"{_subject_score(v)} AS {k}" for k, (_, v) in _SUBJECTS.items())} FROM corpus), m AS (SELECT *, greatest({", ".join(_SUBJECTS)}) AS n FROM n)
SELECT doc_id, CASE WHEN n < 15 THEN 'General' {" ".join(f"WHEN {k} = n THEN {quoted(n)}" for k, (n, _) in _SUBJECTS.items())} END AS subject,
  CASE WHEN n < 15 THEN 0.5 ELSE round(least(98, greatest(55, n)) / 100.0, 4) END::DOUBLE AS subject_confidence FROM m"""
)
def rc_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.subject(corpus(spark, sf_dir)).select("doc_id", "subject", "subject_confidence")


def _tag(expr: str) -> str:
    return f"CASE WHEN {unequal(expr)} THEN 'Text' " + " ".join(f"WHEN regexp_matches({stripped(expr)}, {quoted('(?i)' + p.replace(chr(92) + '•', '•'))}) THEN '{t}'" for t, p in lx.STRUCTURES) + " ELSE 'Text' END"


@query(f"WITH {LINES} SELECT doc_id, CAST(line AS INT) AS line, {_tag('body')} AS structure FROM lines")
def rc_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line", st.structure_of(F.col("body")).alias("structure"))


@query(f"WITH {LINES} SELECT structure, count(*) AS n FROM (SELECT {_tag('body')} AS structure FROM lines) GROUP BY structure")
def rc_structure_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy(st.structure_of(F.col("body")).alias("structure")).agg(F.count(F.lit(1)).alias("n"))


def _heading_steps() -> str:
    out, at = "h0 AS (SELECT doc_id, line, body AS t, 0 AS boost FROM lines)", "h0"
    for k, (p, to) in enumerate(lx.HEADINGS, 1):
        q = quoted("(?i)" + p)
        out += f", h{k} AS (SELECT doc_id, line, regexp_replace(t, {q}, {quoted(to)}, 'g') AS t, boost + CASE WHEN regexp_matches(t, {q}) THEN 12 ELSE 0 END AS boost FROM {at})"
        at = f"h{k}"
    return out


@query(f"WITH {LINES}, {_heading_steps()} SELECT doc_id, CAST(line AS INT) AS line, t AS fixed_text, round(boost / 100.0, 4)::DOUBLE AS boost FROM h{len(lx.HEADINGS)}")
def rc_heading_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).withColumnRenamed("body", "text")
    return st.structured_lines(own).select("doc_id", "line", "fixed_text", "boost")


def _recon_steps() -> str:
    out, at = "r0 AS (SELECT doc_id, text AS t, 0 AS n FROM corpus)", "r0"
    for k, (p, to, _, _) in enumerate(lx.RECONSTRUCTIONS, 1):
        q = quoted("(?i)" + p)
        hit = f"regexp_matches(t, {q}) AND regexp_extract(t, {q}, 0) <> {quoted(to)}"
        out += f", r{k} AS (SELECT doc_id, CASE WHEN {hit} THEN regexp_replace(t, {q}, {quoted(to)}) ELSE t END AS t, n + CASE WHEN {hit} THEN 1 ELSE 0 END AS n FROM {at})"
        at = f"r{k}"
    return out


def _boosted() -> str:
    return "CASE " + " ".join(f"WHEN topic = '{t}' THEN {replaced('t', rules)}" for t, rules in lx.TOPIC_WORDS.items()) + " ELSE t END"


@query(
    f"""WITH {CORPUS}, {_recon_steps()}, n AS (SELECT doc_id, {", ".join(f"{_present('text', lx.TOPICS[t][1])} AS {t}" for t in _TOPICS)} FROM corpus),
k AS (SELECT doc_id, CASE WHEN greatest({", ".join(_TOPICS)}) = 0 THEN 'general' {" ".join(f"WHEN {t} = greatest({', '.join(_TOPICS)}) THEN '{t}'" for t in _TOPICS)} END AS topic FROM n)
SELECT doc_id, {_boosted()} AS recon_text, n AS n_segments, CASE WHEN n > 0 THEN 0.96 ELSE 0.82 END::DOUBLE AS recon_confidence, CASE WHEN n > 0 THEN 0.94 ELSE 0.85 END::DOUBLE AS final_confidence
FROM r{len(lx.RECONSTRUCTIONS)} JOIN k USING (doc_id)"""
)
def rc_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.reconstruct(corpus(spark, sf_dir)).select("doc_id", "recon_text", F.size("recon_edits").alias("n_segments"), "recon_confidence", "final_confidence")


# -- proofreading ----------------------------------------------------------

_RULES = ", ".join(
    f"({k}, {quoted(('' if c == 'Capitalization' else '(?i)') + p)}, {quoted(to.replace('$', chr(92)))}, {quoted(c)}, {conf}::DOUBLE)" for k, (p, to, c, conf) in enumerate(lx.LINE_RULES)
)
_CONTRACTIONS = ", ".join(f"({k}, {quoted('(?i)' + p.partition('(?=')[0])}, {quoted(to)}, 'Punctuation Correction', 0.94::DOUBLE)" for k, (p, to) in enumerate(lx.CONTRACTIONS))
#: look-ahead as a condition on the text after a match
_AHEAD = "CASE rule " + " ".join(
    f"WHEN {k} THEN regexp_matches(array_to_string(pieces[k + 2:], ''), {quoted('(?i)^' + p.partition('(?=')[2].removesuffix(')'))})" for k, (p, _) in enumerate(lx.CONTRACTIONS) if "(?=" in p
) + " ELSE true END"


_WORD = "'[\\p{L}\\p{N}_]'"
_ALONE = f"NOT regexp_matches(right(pieces[k], 1), {_WORD}) AND NOT regexp_matches(left(pieces[k + 2], 1), {_WORD})"


def _matched(rules: str, skip: str, where: str = "true") -> str:
    """Suggestions with offsets by the mark-and-split way, for patterns without look-ahead."""
    return f"""shifted AS (SELECT doc_id, line, body, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM lines),
rules(rule, pattern, repl, category, confidence) AS (VALUES {rules}),
hits AS (SELECT s.*, r.*, string_split_regex(regexp_replace(body, pattern, chr(1) || chr(92) || '0' || chr(2), 'g'), '[\\x01\\x02]') AS pieces
  FROM shifted s, rules r WHERE NOT ({unequal('body')}) AND NOT regexp_matches(body, '^({skip})') AND regexp_matches(body, pattern)),
found AS (SELECT doc_id, line, rule, pattern, repl, category, confidence, shift, pieces, unnest(range(1, len(pieces), 2)) AS k FROM hits),
placed AS (SELECT *, pieces[k + 1] AS original, CAST(shift + coalesce(list_sum(list_transform(pieces[1:k], lambda x: length(x))), 0) AS BIGINT) AS "begin" FROM found WHERE {where}),
proposed AS (SELECT *, CASE repl WHEN '@ans' THEN 'Ans: ' || upper(right(original, 1)) WHEN '@capital' THEN upper(left(original, 1)) || lower(substr(original, 2))
  ELSE regexp_replace(original, CASE WHEN pattern LIKE '(?i)%' THEN '(?i)^(?:' || substr(pattern, 5) || ')$' ELSE '^(?:' || pattern || ')$' END, repl) END AS proposed FROM placed),
firsts AS (SELECT * FROM proposed WHERE original <> proposed AND regexp_matches(original, '\\S') QUALIFY row_number() OVER (PARTITION BY doc_id, "begin" ORDER BY rule) = 1)"""


LINE_SQL = f"{LINES}, {_matched(_RULES, '#|===')}"
_FIELDS = 'doc_id, CAST(line AS INT) AS line, CAST("begin" AS INT) AS "begin", CAST("begin" + length(original) AS INT) AS stop, original, proposed, category, confidence'
COLUMNS = ("doc_id", "line", "begin", "stop", "original", "proposed", "category", "confidence")


def line_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.first_per_start(pr.line_rules(corpus(spark, sf_dir), "text", ["doc_id"]), ["doc_id"]).select(*COLUMNS)


@query(f"WITH {LINE_SQL} SELECT {_FIELDS} FROM firsts")
def pr_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_suggestions(spark, sf_dir)


@query(f"WITH {LINES}, {_matched(_CONTRACTIONS, '#|[|]|===', f'{_ALONE} AND {_AHEAD}')} SELECT {_FIELDS} FROM firsts")
def pr_contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("body")
    own = pr.lines_of(corpus(spark, sf_dir), "text", ["doc_id"]).where(~tx.blank(body) & ~body.startswith("#") & ~body.startswith("|") & ~body.startswith("==="))
    return pr.first_per_start(pr.contractions(own, ["doc_id"]), ["doc_id"]).select(*COLUMNS)


_METRICS = """SELECT doc_id, count(*) FILTER (category = 'Spelling Correction') AS spelling_errors, count(*) FILTER (category IN ('Grammar Correction', 'Sentence Structure')) AS grammar_errors,
  count(*) FILTER (category = 'Missing Word') AS missing_words, count(*) FILTER (category IN ('Punctuation Improvement', 'Capitalization')) AS punctuation_corrections,
  count(*) FILTER (category = 'Contextual Substitution') AS contextual_substitutions, count(*) AS total_suggestions FROM firsts GROUP BY doc_id"""


@query(f"WITH {LINE_SQL} {_METRICS}")
def pr_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.metrics(line_suggestions(spark, sf_dir))


@query(
    f"""WITH {LINE_SQL}, p AS (SELECT doc_id, count(*) AS n FROM firsts WHERE confidence < 0.9 GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS pending, CAST(CASE WHEN coalesce(n, 0) = 0 THEN 100 ELSE greatest(50, floor(100 - 3.5 * n + 0.5)) END AS INT) AS quality_score FROM corpus LEFT JOIN p USING (doc_id)"""
)
def pr_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions of 0.9 or more count as accepted."""
    own = _numbered(spark, sf_dir)
    n = pr.pending(own, own.where("confidence >= 0.9").select("doc_id", "suggestion_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    out = corpus(spark, sf_dir).join(n, "doc_id", "left").withColumn("pending", F.coalesce("n", F.lit(0)))
    return out.select("doc_id", "pending", pr.quality_score(F.col("pending")).alias("quality_score"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.numbered(line_suggestions(spark, sf_dir).withColumns({"stage": F.lit(3), "rule": F.lit(0)}), ["doc_id"])


@query(f"WITH {LINE_SQL}, n AS (SELECT *, 'sug_' || row_number() OVER (PARTITION BY doc_id ORDER BY \"begin\") AS suggestion_id FROM firsts) SELECT doc_id, suggestion_id, category FROM n WHERE category = 'Character Confusion' AND confidence < 0.95 AND contains(lower(original || chr(10) || proposed || chr(10) || category), 'e')")
def pr_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _numbered(spark, sf_dir)
    decided = own.where("confidence >= 0.95").select("doc_id", "suggestion_id")
    return pr.pending(own, decided, category="Character Confusion", search="e").select("doc_id", "suggestion_id", "category")


@query(f"WITH {LINE_SQL}, n AS (SELECT *, 'sug_' || row_number() OVER (PARTITION BY doc_id ORDER BY \"begin\") AS suggestion_id FROM firsts) SELECT doc_id, suggestion_id FROM n WHERE confidence >= 0.92 OR suggestion_id = 'sug_1'")
def pr_accept_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _numbered(spark, sf_dir)
    return pr.accept_confident(own, own.where("suggestion_id = 'sug_1'"), least=0.92)


# -- all stages ------------------------------------------------------------


def _family(name: str, stage: int, rules: list[tuple], source: str, skip: str = "", case: bool = False) -> str:
    """CTEs that end in ``name``: suggestions of rules (number, pattern, replacement, category, confidence, whether case counts) in the texts of ``source``
    (doc_id, line, shift, body). A look-ahead is a condition on what follows a match, and word boundaries are held to letters of all scripts."""
    rows = []
    for number, pattern, to, category, confidence, strict in rules:
        bare, _, ahead = pattern.partition("(?=")
        flag = "" if strict else "(?i)"
        ahead = quoted(f"{flag}^(?:{ahead.removesuffix(')')})") if ahead else "NULL"
        ends = bare.endswith((r"\b", r"\b)"))
        rows.append(f"({number}, {quoted(flag + bare)}, {quoted(to.replace('$', chr(92)))}, {quoted(category)}, {confidence}::DOUBLE, {ahead}, {str(bare.startswith(chr(92) + 'b')).lower()}, {str(ends).lower()}, {quoted(f'{flag}^(?:{bare})$'.replace('(?:^', '(?:'))})")
    skipped = f"AND NOT regexp_matches(body, '^({skip})')" if skip else ""
    kept = "CASE WHEN regexp_matches(left(original, 1), '\\p{Lu}') AND p <> '' AND NOT regexp_matches(left(p, 1), '\\p{Lu}') THEN upper(left(p, 1)) || lower(substr(p, 2)) ELSE p END" if case else "p"
    return f"""{name}_r(rule, pattern, repl, category, confidence, ahead, from_edge, to_edge, whole) AS (VALUES {", ".join(rows)}),
{name}_h AS (SELECT s.*, r.*, string_split_regex(regexp_replace(body, pattern, chr(1) || chr(92) || '0' || chr(2), 'g'), '[\\x01\\x02]') AS pieces FROM {source} s, {name}_r r WHERE NOT ({unequal('body')}) {skipped} AND regexp_matches(body, pattern)),
{name}_f AS (SELECT * EXCLUDE (body), unnest(range(1, len(pieces), 2)) AS k FROM {name}_h),
{name}_p AS (SELECT *, pieces[k + 1] AS original, CAST(shift + coalesce(list_sum(list_transform(pieces[1:k], lambda x: length(x))), 0) AS BIGINT) AS "begin" FROM {name}_f
  WHERE (ahead IS NULL OR regexp_matches(array_to_string(pieces[k + 2:], ''), ahead)) AND NOT (from_edge AND regexp_matches(right(pieces[k], 1), {_WORD})) AND NOT (to_edge AND regexp_matches(left(pieces[k + 2], 1), {_WORD}))),
{name}_q AS (SELECT *, CASE repl WHEN '@ans' THEN 'Ans: ' || upper(right(original, 1)) WHEN '@capital' THEN upper(left(original, 1)) || lower(substr(original, 2)) ELSE regexp_replace(original, whole, repl) END AS p FROM {name}_p),
{name} AS (SELECT doc_id, {stage} AS stage, rule, "begin", "begin" + length(original) AS stop, original, {kept} AS proposed, category, confidence, line FROM {name}_q WHERE regexp_matches(original, '\\S') AND original <> {kept})"""


def _recon_edits() -> str:
    out, at = "e0 AS (SELECT doc_id, text AS t, CAST([] AS STRUCT(rule INT, b BIGINT, o VARCHAR, p VARCHAR, c DOUBLE)[]) AS edits FROM corpus)", "e0"
    for k, (p, to, _, confidence) in enumerate(lx.RECONSTRUCTIONS):
        q = quoted("(?i)" + p)
        hit = f"regexp_matches(t, {q}) AND regexp_extract(t, {q}, 0) <> {quoted(to)}"
        edit = f"{{'rule': {k}, 'b': length(string_split_regex(t, {q})[1]), 'o': regexp_extract(t, {q}, 0), 'p': {quoted(to)}, 'c': {confidence}::DOUBLE}}"
        out += f", e{k + 1} AS (SELECT doc_id, CASE WHEN {hit} THEN regexp_replace(t, {q}, {quoted(to)}) ELSE t END AS t, CASE WHEN {hit} THEN list_append(edits, {edit}) ELSE edits END AS edits FROM {at})"
        at = f"e{k + 1}"
    return out


_CONTEXT = [(k, p, to, c, conf, False) for k, (p, to, c, conf) in enumerate(lx.CONTEXT)]
_LINES = [(k, p, to, c, conf, c == "Capitalization") for k, (p, to, c, conf) in enumerate(lx.LINE_RULES)]
_SHORT = [(k, p, to, "Punctuation Correction", 0.94, False) for k, (p, to) in enumerate(lx.CONTRACTIONS)]
_EDGES = [(100, lx.POSSESSIVE, "$1's", "Punctuation Correction", 0.92, False), (400, lx.BOUNDARY, "$1. $2", "Punctuation Correction", 0.88, True)]
_QUESTION = [(200, lx.QUESTION, "?", "Punctuation Correction", 0.92, False)]
_OPENED = "(?i)" + lx.OPENER

SUGGESTIONS = f"""{CORPUS}, {_recon_edits()}, topics AS (SELECT doc_id, {", ".join(f"{_present('text', lx.TOPICS[t][1])} AS {t}" for t in _TOPICS)} FROM corpus),
topic AS (SELECT doc_id, CASE WHEN greatest({", ".join(_TOPICS)}) = 0 THEN 'general' {" ".join(f"WHEN {t} = greatest({', '.join(_TOPICS)}) THEN '{t}'" for t in _TOPICS)} END AS topic FROM topics),
recon AS (SELECT doc_id, {_boosted()} AS text FROM e{len(lx.RECONSTRUCTIONS)} JOIN topic USING (doc_id)), {RECOVERED.replace("FROM corpus", "FROM recon")},
target AS MATERIALIZED (SELECT doc_id, CASE WHEN {unequal('recovered_text')} THEN text ELSE recovered_text END AS text FROM rec),
tl0 AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS body FROM target),
tl AS MATERIALIZED (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM tl0),
tw AS (SELECT doc_id, 1 AS line, text AS body, 0 AS shift FROM target),
{_family("short", 1, _SHORT, "tl", "#|[|]|===")}, {_family("edges", 1, _EDGES, "tl", "#|[|]|===")}, {_family("asked", 1, _QUESTION, "tl", "#|[|]|===")},
{_family("context", 2, _CONTEXT, "tw", case=True)}, {_family("linewise", 3, _LINES, "tl", "#|===")},
opened AS (SELECT doc_id, line, shift, left(body, length(regexp_extract(body, {quoted(_OPENED)}, 1)) + 2) AS original, regexp_extract(body, {quoted(_OPENED)}, 1) AS word, regexp_extract(body, {quoted(_OPENED)}, 2) AS letter
  FROM tl WHERE regexp_matches(body, {quoted(_OPENED)}) AND NOT regexp_matches(body, '^(#|[|]|===)')),
every AS (
  SELECT doc_id, 0 AS stage, e.rule AS rule, e.b AS "begin", e.b + length(e.o) AS stop, e.o AS original, e.p AS proposed, 'Document Reconstruction' AS category, e.c AS confidence, 1 AS line FROM (SELECT doc_id, unnest(edits) AS e FROM e{len(lx.RECONSTRUCTIONS)})
  UNION ALL SELECT * FROM short UNION ALL SELECT * FROM edges UNION ALL SELECT * FROM context UNION ALL SELECT * FROM linewise
  UNION ALL SELECT doc_id, 1, 200, "begin" + length({stripped("original")}), "begin" + length({stripped("original")}), '', '?', 'Punctuation Correction', 0.92::DOUBLE, line FROM asked_p WHERE NOT {stripped("original")} LIKE '%?'
  UNION ALL SELECT doc_id, 1, 300, shift, shift + length(original), original, upper(left(word, 1)) || lower(substr(word, 2)) || ', ' || letter, 'Punctuation Correction', 0.94::DOUBLE, line FROM opened
    WHERE original <> upper(left(word, 1)) || lower(substr(word, 2)) || ', ' || letter),
chosen AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, "begin" ORDER BY stage, rule, stop) = 1),
suggested AS MATERIALIZED (SELECT doc_id, 'sug_' || row_number() OVER (PARTITION BY doc_id ORDER BY "begin") AS suggestion_id, CAST("begin" AS INT) AS "begin", CAST(stop AS INT) AS stop, original, proposed, category, confidence, CAST(line AS INT) AS line,
  CASE stage WHEN 0 THEN 'raw' ELSE 'target' END AS offset_space FROM chosen)"""


@query(f"WITH {SUGGESTIONS} SELECT * FROM suggested")
def pr_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages."""
    return pr.suggest(corpus(spark, sf_dir)).select("doc_id", "suggestion_id", "begin", "stop", "original", "proposed", "category", "confidence", "line", "offset_space")


@query(
    f"""WITH {SUGGESTIONS}, edits AS (SELECT doc_id, list({{'b': "begin", 's': stop, 'p': proposed}} ORDER BY "begin" DESC) AS edits FROM suggested WHERE category <> 'Document Reconstruction' AND confidence >= 0.70 GROUP BY doc_id)
SELECT doc_id, CASE WHEN edits IS NULL THEN text ELSE list_reduce(list_prepend({{'b': 0, 's': 0, 'p': text}}, list_filter(edits, lambda e: e.b >= 0 AND e.b <= e.s AND e.s <= length(text))),
  lambda acc, e: {{'b': 0, 's': 0, 'p': left(acc.p, e.b) || e.p || substr(acc.p, e.s + 1)}}).p END AS corrected_text FROM target LEFT JOIN edits USING (doc_id)"""
)
def pr_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = pr.analyze(corpus(spark, sf_dir))
    return docs.select("doc_id", "corrected_text")


_ASCII_LETTERS = "regexp_replace({}, '[^\\x00-\\x7F]', '_', 'g')"


@query(
    f"""WITH {LINES}, v AS (SELECT word, count(*) AS f FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all({_ASCII_LETTERS.format('lower(text)')}, '\\b[a-z]{{4,}}\\b')) AS word FROM corpus) GROUP BY word HAVING count(*) >= 20),
shifted AS (SELECT doc_id, line, body, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM lines),
split AS (SELECT doc_id, line, shift, string_split_regex(regexp_replace({_ASCII_LETTERS.format('body')}, '\\b[A-Za-z]{{4,}}\\b', chr(1) || chr(92) || '0' || chr(2), 'g'), '[\\x01\\x02]') AS pieces FROM shifted),
found AS (SELECT *, unnest(range(1, len(pieces), 2)) AS k FROM split),
words AS MATERIALIZED (SELECT doc_id, line, pieces[k + 1] AS original, CAST(shift + list_sum(list_transform(pieces[1:k], lambda x: length(x))) AS BIGINT) AS "begin" FROM found WHERE regexp_matches(pieces[k + 1], '^[a-z]')),
u AS MATERIALIZED (SELECT DISTINCT lower(original) AS w FROM words WHERE lower(original) NOT IN (SELECT word FROM v)),
best AS (SELECT w, arg_min(word, {{'f': -f, 'w': word}}) AS proposed FROM u JOIN v ON abs(length(w) - length(word)) <= 1 AND levenshtein(w, word) = 1 GROUP BY w)
SELECT doc_id, CAST("begin" AS INT) AS "begin", CAST("begin" + length(original) AS INT) AS stop, original, proposed, CAST(line AS INT) AS line FROM words JOIN best ON lower(original) = w"""
)
def pr_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the words that occur in 20 documents or more."""
    docs = corpus(spark, sf_dir)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z]{4,})\b"), 1))
    vocabulary = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("frequency")).where("frequency >= 20")
    return pr.spelling(docs, "text", ["doc_id"], vocabulary).select("doc_id", "begin", "stop", "original", "proposed", "line")
