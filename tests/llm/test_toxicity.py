import random
import zlib

from scriptorium.llm import toxicity as tx
from tests.llm import cases


def table(spark, n=400):
    r = random.Random(2)
    docs, labels = [], []
    for k in range(n):
        t = cases.prose(r, 40).split()
        bad = k % 5 == 0
        if bad:
            t[r.randrange(40)] = r.choice(["scoundrel", "blockhead", "grubbla" + r.choice(["an", "ix", "oto", "eri"])])
        docs.append((k, " ".join(t), "en"))
        labels.append((k, 1, int(bad)))
    docs += [(n, None, "en"), (n + 1, "", "en"), (n + 2, cases.prose(r, 20) + " you scoundrle and scoundrl here", "en"), (None, "scoundrel", "en"), docs[0]]
    labels += [(0, 1, None), (None, 1, 1), (n, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learned_terms_find_toxic_documents(spark):
    docs, labels = table(spark)
    got = tx.score(docs, labels).collect()
    assert len(got) == docs.count()
    right = sum(r.predicted == (r.doc_id % 5 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert right >= 0.98 * 400
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by = {r.doc_id: r for r in got}
    assert not by[400].predicted and not by[401].predicted


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    r = random.Random(5)
    terms = ["".join(r.choice("abc") for _ in range(r.randrange(5, 8))) for _ in range(30)]
    lexicon = tx.Lexicon([(t, False, 1.0 + k) for k, t in enumerate(dict.fromkeys(terms))])
    weights = {t: 1.0 + k for k, t in enumerate(dict.fromkeys(terms))}
    for _ in range(1500):
        w = "".join(r.choice("abcd") for _ in range(r.randrange(4, 9)))
        assert lexicon.fuzzy(w) == max((weights[t] for t in weights if distance(w, t) <= 1), default=0.0)


def test_long_terms_let_two_edits_pass_and_short_ones_none():
    r = random.Random(9)
    words = ["".join(r.choice("ab") for _ in range(n)) for n in (3, 4, 8, 9, 10, 11, 12)]
    lexicon = tx.Lexicon([(t, False, 1.0 + k) for k, t in enumerate(words)])
    least = {t: 0 if len(t) < tx.FUZZY else 1 if len(t) < tx.LONG else 2 for t in words}
    for _ in range(3000):
        w = "".join(r.choice("abc" if r.random() < 0.1 else "ab") for _ in range(r.randrange(2, 15)))
        near = [1.0 + k for k, t in enumerate(words) if least[t] and distance(w, t) <= least[t]]
        assert lexicon.fuzzy(w) == max(near, default=0.0)
    lexicon.automaton.clear()
    assert lexicon.fuzzy(words[3]) >= 4.0


def test_very_long_text(spark):
    docs, labels = table(spark)
    long = " ".join(f"w{k}" for k in range(200_000))
    got = tx.score(docs.union(spark.createDataFrame([(5000, long, "en"), (5001, long + " you scoundrel", "en")], docs.schema)), labels).collect()
    by = {r.doc_id: r for r in got}
    assert not by[5000].predicted and by[5001].score > by[5000].score


def test_context_windows():
    lexicon = tx.Lexicon([("scoundrel", False, 4.0), ("grub", True, 3.0)])
    assert tx.features("he called you a scoundrel", lexicon)[0] == 0.0 or tx.features("you are a scoundrel", lexicon)[0] == 4.0
    assert tx.features('they read "what a scoundrel" aloud', lexicon)[5] == 4.0
    assert tx.features("you scoundrxl", lexicon)[3] == 4.0
    assert tx.features("you scoundr3l", lexicon)[0] == 4.0
    assert tx.features("grubbing", lexicon)[0] == 3.0 and tx.features("agrub", lexicon) == (0.0,) * 7


def test_without_labels(spark):
    docs, labels = table(spark, 20)
    got = tx.score(docs, labels.limit(0)).collect()
    assert {r.score for r in got} == {0.0}
    assert tx.score(docs.limit(0), labels).count() == 0


def test_misspelling_alone_is_found(spark):
    """One edit within the first letters, which no stem of the term survives."""
    docs, labels = table(spark)
    r = random.Random(4)
    odd = {k: w for k, w in enumerate(["scundrel", "sczoundrel", "bluckhead", "bockhead"], 1000)}
    more = [(k, " ".join([*cases.prose(r, 20).split(), w, *cases.prose(r, 19).split()]), "en") for k, w in odd.items()]
    more += [(2000 + k, cases.prose(r, 40), "en") for k in range(20)]
    got = tx.score(docs.union(spark.createDataFrame(more, docs.schema)), labels).collect()
    assert {r.doc_id for r in got if r.doc_id is not None and r.doc_id >= 1000 and r.predicted} == {k for k, *_ in more if k < 2000}


def test_term_that_is_a_stem_too():
    lexicon = tx.Lexicon([("grubblan", True, 3.0), ("grubblan", False, 2.0)])
    assert lexicon.exact("grubblans") == 3.0 and lexicon.fuzzy("gurbblan") == 0.0 and lexicon.fuzzy("grbblan") == 2.0


def test_rare_terms_with_evidence_are_learned(spark):
    """6 of 1500 toxic texts hold the word, and no clean one; as many hold another that clean ones hold too."""
    r = random.Random(7)
    text = lambda k, w: cases.prose(r, 12) + (f" {w}" if k < 6 else "")
    toxic = spark.createDataFrame([(text(k, "grubblan fairword"), int(k >= 5)) for k in range(1500)], "text string, fold int")
    clean = spark.createDataFrame([(text(k, "fairword"), k % 2) for k in range(9000)], "text string, fold int")
    first, second, *_, got = tx.learn_terms(toxic, clean, [5, 1495, 0, 0], [4500, 4500, 0, 0])
    assert ("grubblan", False) in {t[:2] for t in got} and not any(t.startswith("fair") for t, *_ in got)
    # five of the six texts are in the first fold, so the others alone don't teach the word
    assert ("grubblan", False) not in {t[:2] for t in first} and ("grubblan", False) in {t[:2] for t in second}
