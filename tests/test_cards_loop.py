"""Cards of all corrections of the conversations against a loop in plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from scriptorium.operators import cards as dk
from scriptorium.plans import learning

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r\x85\xa0"


def clean(s):
    s = re.sub("[\r\n\t]+", " ", s)
    s = re.sub("([,.:;!?])([a-zA-Z0-9])", r"\1 \2", s)
    s = re.sub("([a-z])([A-Z])", r"\1 \2", s)
    return re.sub(" +", " ", s).strip(WHITE)


def sentences(text, begin, stop, o, p):
    left, right = text[:begin], text[stop:]
    a, z = re.search(r"([^.!?\n]*)\Z", left)[1], re.match(r"[^.!?\n]*", right)[0]
    whole = (a + text[begin:stop] + z).strip(WHITE)
    if not (0 <= begin < stop <= len(text)) or not clean(whole):
        return clean(f"The sentence contained '{o}'."), clean(f"The sentence was corrected to '{p}'.")
    hit = re.search(rf"\b{re.escape(o)}\b", whole)
    at = hit.start() if hit else whole.find(o)
    if o and at >= 0:
        new = whole[:at] + p + whole[at + len(o) :]
    else:
        new = a + (" " if a and not a.endswith(" ") else "") + p + (" " if z and z[0] not in " ,.!?;:" else "") + z
    return clean(whole), clean(new)


def style_of(c, o, p, e):
    c, e = c.lower(), e.lower()
    has = lambda s, *words: any(w in s for w in words)
    if has(c, "spelling", "typo") or has(e, "spell"):
        return "spelling", "Spelling Correction"
    if has(c, "missing", "omitted") or has(e, "missing"):
        return "fill_in_blank", "Missing Word"
    if has(c, "punctuation", "comma", "period"):
        return "punctuation_practice", "Punctuation"
    if has(c, "capital") or o.lower() == p.lower():
        return "capitalization_rule", "Capitalization"
    if has(c, "vocab", "style") or has(e, "word choice"):
        return "vocabulary", "Vocabulary Improvement"
    if has(c, "structur") or len(o.split()) > 3:
        return "sentence_reconstruction", "Sentence Structure"
    return "grammar_explanation", "Grammar Correction"


def level(s, o, p, sentence, e):
    n, e = len(sentence.split()), e.lower()
    if s in ("spelling", "capitalization_rule"):
        return "Easy" if len(o) <= 6 and abs(len(o) - len(p)) <= 1 else "Medium"
    if s in ("fill_in_blank", "punctuation_practice"):
        return "Easy" if n <= 8 else "Medium"
    if s == "vocabulary":
        return "Hard" if len(p) >= 9 or "academic" in e else "Medium"
    if s == "sentence_reconstruction":
        return "Hard" if n > 12 else "Medium"
    return "Medium" if any(w in e for w in ("subj", "tense", "clause")) else "Hard" if n > 15 else "Easy"


def tags(category, s, o, p, e):
    e, o = e.lower(), o.lower()
    found = {category}
    for test, tag in (
        ("verb" in e or "tense" in e, "Verb Tense"), ("subject" in e or "agreement" in e, "Subject-Verb Agreement"), ("article" in e or o in ("a", "an", "the"), "Articles"),
        ("prep" in e or o in ("in", "on", "at", "to", "for", "with", "by", "from"), "Prepositions"), (s == "vocabulary" or len(p) >= 8, "Academic Vocabulary"), ("ocr" in e, "OCR Recovery"), (s == "sentence_reconstruction", "Sentence Structure"),
    ):
        if test:
            found.add(tag)
    return sorted(found)


def gapped(sentence, word):
    at = sentence.find(word)
    return sentence[:at] + "[ _____ ]" + sentence[at + len(word) :] if word and at >= 0 else None


def loop(rows):
    """Cards by (conv_id, turn, concept) of corrections (conv_id, turn, ord, text, original, proposed, category, explanation, confidence, begin, stop)."""
    out = {}
    for r in sorted(rows, key=lambda r: r.ord):
        o, p = r.original.strip(WHITE), r.proposed.strip(WHITE)
        if not o or not p or o == p:
            continue
        before, after = sentences(r.text, r.begin, r.stop, o, p)
        concept = f"{r.category.lower()}:{o.lower()}->{p.lower()}"
        key = r.conv_id, r.turn, concept
        if key in out:
            out[key]["extra_examples"].append(after)
            continue
        s, category = style_of(r.category, o, p, r.explanation)
        change = f"Change '{o}' to '{p}'"
        wrong = o
        options = {
            "spelling": [p, wrong if wrong != p else p + "e"], "fill_in_blank": [p, "and", "which", "however"],
            "grammar_explanation": [change, f"Remove '{o}' entirely", f"Move '{o}' to end of sentence"],
        }.get(s)
        fill = lambda frame: frame.replace("{o}", o).replace("{p}", p)
        rule = fill(dk.RULES[s])
        own = r.explanation if len(r.explanation) > 10 else f"Replacing '{o}' with '{p}' ensures grammatical accuracy and clarity."
        out[key] = {
            "card_id": "fc_" + hashlib.md5(f"{r.conv_id}|{r.turn}|{concept}".encode()).hexdigest()[:8], "category": category, "card_style": s, "original": o, "proposed": p, "original_sentence": before,
            "corrected_sentence": after, "difficulty": level(s, o, p, before, r.explanation), "tags": tags(category, s, o, p, r.explanation), "rule": rule, "learning_objective": fill(dk.OBJECTIVES[s]),
            "confidence": r.confidence, "explanation": f"{own} {rule}", "extra_examples": [],
            "front": (fill(dk.FRONTS[s][0]), fill(dk.FRONTS[s][1]), dk.FRONTS[s][2], (gapped(after, p) or gapped(before, o) or before) if s == "fill_in_blank" else before,
                      p if s == "vocabulary" else o if s in ("spelling", "capitalization_rule", "grammar_explanation") else None, options, f"Initial letter: {p[0].upper()}" if s == "fill_in_blank" else None,
                      after.split() if s == "sentence_reconstruction" else None),
            "answer": after if s in ("punctuation_practice", "sentence_reconstruction") else change if s == "grammar_explanation" else p,
        }
    return out


def test_cards_of_the_conversations(spark):
    docs, rows = learning.conversation_corrections(spark, SF)
    want = loop(rows.join(docs.select("conv_id", "turn", "text"), ["conv_id", "turn"]).collect())
    got = dk.build_cards(docs, rows, ["conv_id", "turn"]).collect()
    assert len(got) == len(want) > 500
    by = {(c["card_id"]): c for c in want.values()}
    for r in got:
        c = by[r.card_id]
        for name in ("category", "card_style", "original", "proposed", "original_sentence", "corrected_sentence", "difficulty", "tags", "rule", "learning_objective", "confidence", "explanation", "extra_examples"):
            assert r[name] == c[name], (name, r[name], c[name])
        assert tuple(r.front) == c["front"] and r.back.correct_answer == c["answer"] and r.n_merged == 1 + len(c["extra_examples"])


def test_the_query_has_these_cards(spark):
    docs, rows = learning.conversation_corrections(spark, SF)
    made = learning.dk_cards(spark, SF)
    assert made.select("card_id").exceptAll(dk.build_cards(docs, rows, ["conv_id", "turn"]).select("card_id")).count() == 0
    assert made.where(F.col("sense").contains(".det.") | F.col("sense").contains(".noun.")).count() > 0


def test_the_sentence_of_a_long_text_is_found_in_time_linear_in_it(spark):
    import time

    from pyspark.sql import functions as F

    from scriptorium.operators import cards as dk

    long = "word " * 60_000  # a sentence tried from each of its characters that a later stop ends would take minutes
    for text, was, now in ((long + ". A cat sat\nhere", "A cat sat", "A dog sat"), (long + "\nA cat sat\r\n", "A cat sat", "A dog sat"), (long + "!\ncat", "cat", "dog")):
        df = spark.createDataFrame([(text,)], "text string").withColumn("begin", F.position(F.lit("cat"), "text") - 1)
        began = time.time()
        got = df.select(dk.context_sentences(F.col("text"), F.col("begin"), F.col("begin") + 3, F.lit("cat"), F.lit("dog")).alias("x")).first().x
        assert (got.was, got.now) == (was, now) and time.time() - began < 15
