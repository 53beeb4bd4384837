"""Small tables with what real ones have: copies, near copies, repeats, nulls, blanks, long texts, ties."""

import random

WORDS = "the of and house river stone light green walk seven paper cloud storm ember quiet north sail copper field lamp".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) + "." * (k % 9 == 8) for k in range(n)) + "."


def texts(seed: int = 1) -> list:
    r = random.Random(seed)
    base = [prose(r, r.randrange(60, 200)) for _ in range(30)]
    passage = prose(r, 90)
    out = [*base, base[3], base[3], base[5][:-40] + " tail words here.", None, "", "   \n\t ", "a b", "one two three", "über gaß éé " * 40]
    out += [f"{base[7]}\n{passage}\n{base[8]}", f"{prose(r, 30)}\n{passage}", passage]
    out += ["spam spam " * 300, "x" * 5000, "\n".join([prose(r, 12)] * 6), "ab" * 600, base[9].upper(), base[9].replace(" ", "\r\n\v")]
    out += [" ".join(w + "###$$%" for w in base[1].split()), prose(r, 3000)]
    return out


def rows(seed: int = 1) -> list[tuple]:
    """(doc_id, text) with a repeated row and a null id."""
    out = [(k * 3 + 1, t) for k, t in enumerate(texts(seed))]
    return [*out, out[4], (None, "a null id has a text too " * 30)]


def documents(spark, seed: int = 1):
    """With extra columns whose names operators use inside."""
    data = [(i, t, "en", k, "x", 1.5) for k, (i, t) in enumerate(rows(seed))]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, h long, pattern string, row double").repartition(3)


def empty(spark):
    return documents(spark).limit(0)
