import difflib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import line_dedup as ld
from tests.llm import cases


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_alignment_is_monotone(a, b):
    pairs = ld.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    if a == b:
        assert len(pairs) == len(a)


def test_unique_lines_align_like_a_longest_common_subsequence():
    r = random.Random(3)
    for _ in range(100):
        a = r.sample(range(30), 12)
        b = [x for x in a if r.random() < 0.7] + r.sample(range(30, 40), 3)
        assert len(ld.patience(a, b)) >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks()) - 0


def brute(rows, least=ld.MIN_BLOCK):
    """Each document against each earliest holder of one of its lines."""
    docs = [(i if i is not None else 1 << 62, k, (t or "").split("\n")) for k, (i, t) in enumerate(rows)]
    first = {}
    for d in sorted(docs, key=lambda d: d[:2]):
        for x in d[2]:
            if x.strip(" \t\n\v\f\r"):
                first.setdefault(x, d)
    out = []
    for d in docs:
        own = [(k, x) for k, x in enumerate(d[2]) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for e in {first[x][1]: first[x] for _, x in own}.values():
            if e[1] != d[1]:
                early = [x for x in e[2] if x.strip(" \t\n\v\f\r")]
                gone.update(own[j][0] for j in ld.common_blocks(early, [x for _, x in own], [len(x) for _, x in own], least))
        out.append((rows[d[1]][0], None if rows[d[1]][1] is None else "\n".join(x for k, x in enumerate(d[2]) if k not in gone), len(gone)))
    return sorted(out, key=repr)


def lined(seed=1):
    r = random.Random(seed)
    lines = [cases.prose(r, r.randrange(1, 20)) for _ in range(40)]
    out = []
    for k in range(40):
        at = r.randrange(30)
        body = lines[at : at + r.randrange(1, 8)] + [cases.prose(r, 9)] * r.randrange(3) + ["", " \t"]
        out.append((k, "\n".join(body)))
    return [*out, (50, None), (51, ""), (None, out[3][1]), (52, out[3][1]), (53, "\n\n")]


def test_against_brute_force(spark):
    rows = lined()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, gone int, rid string").repartition(3)
    got = ld.deduplicate(df)
    assert got.columns == [*df.columns, "n_removed_lines"]
    assert sorted(((r.doc_id, r.text, r.n_removed_lines) for r in got.collect()), key=repr) == brute(rows)


def test_copies_lose_everything_but_the_first(spark):
    text = "\n".join(cases.prose(random.Random(8), 15) for _ in range(6))
    df = spark.createDataFrame([(k, text) for k in range(9)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed_lines for r in ld.deduplicate(df).collect()} == {k: 6 if k else 0 for k in range(9)}


def test_empty(spark):
    assert ld.deduplicate(cases.empty(spark)).count() == 0


def test_repeated_and_moved_blocks_go():
    p, q = ["p" * 30, "q" * 30], ["r" * 60]
    sizes = lambda x: [len(k) for k in x]
    late = ["x", *p, "y", *p, "z"]
    assert ld.common_blocks(["a", *p, "b"], late, sizes(late)) == [1, 2, 4, 5]
    late = [*q, "y", *p]
    assert ld.common_blocks([*p, "m", *q], late, sizes(late)) == [0, 2, 3]


def test_block_whose_lines_have_other_first_holders(spark):
    a, b, c = "first short line of it all", "second short line of it all", "third line"
    rows = [(1, f"{a}\nown"), (2, f"{b}\nother"), (3, f"{a}\n{b}\nmore"), (4, f"{a}\n{b}\n{c}"), (5, f"x\n{a}\n{b}\n{c}\ny")]
    got = {r.doc_id: r.text for r in ld.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: c, 5: "x\ny"}


def all_pairs(rows, least=ld.MIN_BLOCK):
    """(doc_id, deleted places) with each document aligned with every earlier one that shares a line."""
    docs = [(i, [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")]) for i, t in rows]
    by, holders, out = dict(docs), {}, {}
    for i, own in sorted(docs):
        gone = set()
        for e in {e for _, x in own for e in holders.get(x, ())}:
            found = ld.common_blocks([x for _, x in by[e]], [x for _, x in own], [len(x) for _, x in own], least)
            gone.update(own[j][0] for j in found)
        for _, x in own:
            holders.setdefault(x, set()).add(i)
        out[i] = gone
    return out


def deleted(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    return rows, {r.doc_id: (r.n_removed_lines, r.text) for r in ld.deduplicate(docs).collect()}


def test_no_block_of_any_pair_is_lost(spark):
    rows, got = deleted(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    for i, gone in all_pairs(list(rows.items())).items():
        assert got[i] == (len(gone), "\n".join(x for k, x in enumerate(rows[i].split("\n")) if k not in gone))


def test_a_block_whose_lines_have_other_earliest_holders(spark):
    x, z = "x" * 30, "z" * 30
    docs = spark.createDataFrame([(1, f"{x}\np1"), (2, f"{z}\np2"), (3, f"{x}\n{z}"), (4, f"{x}\n{z}")], "doc_id long, text string")
    assert deleted(spark, docs)[1] == {1: (0, f"{x}\np1"), 2: (0, f"{z}\np2"), 3: (0, f"{x}\n{z}"), 4: (2, "")}


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a" * 60, 5, 6, 7, 8), (2, "a" * 60, 5, 6, 7, 8)], "doc_id long, text string, rid long, _RID long, gone long, n_removed_lines long")
    got = ld.deduplicate(docs)
    assert got.columns == ["doc_id", "text", "rid", "_RID", "gone", "n_removed_lines"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a" * 60, 5, 6, 7, 0), (2, "", 5, 6, 7, 1)]


def test_only_aligned_lines_are_deleted(spark, monkeypatch):
    """Without the alignment nothing goes: a shared run names stretches, it deletes none."""
    rows = lined()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ld.deduplicate(df).agg({"n_removed_lines": "sum"}).first()[0] > 0
    early, late = ["p" * 30, "q" * 30, "r" * 60], ["r" * 60, "y", "p" * 30, "q" * 30]
    assert ld.common_blocks(early, late, [len(x) for x in late]) == [0, 2, 3]
    monkeypatch.setattr(ld, "patience", lambda a, b: [])
    assert ld.common_blocks(early, late, [len(x) for x in late]) == []


def plain_pairs(rows, least=ld.MIN_BLOCK):
    """(doc_id, deleted places): lines of common substrings of lines, by a table of matches of every pair, without the operator's functions."""
    docs = [(i, [(k, x) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")]) for i, t in sorted(rows)]
    out = {}
    for n, (i, own) in enumerate(docs):
        gone, lines = set(), {x for _, x in own}
        for _, early in docs[:n]:
            if not any(x in lines for _, x in early):
                continue
            before = [0] * (len(early) + 1)
            for b in range(len(own)):
                now = [0] * (len(early) + 1)
                for a in range(len(early)):
                    if early[a][1] == own[b][1]:
                        now[a + 1] = before[a] + 1
                        if sum(len(own[j][1]) for j in range(b - now[a + 1] + 1, b + 1)) >= least:
                            gone.update(own[j][0] for j in range(b - now[a + 1] + 1, b + 1))
                before = now
        out[i] = gone
    return out


def test_against_a_table_of_all_pairs(spark):
    rows, got = deleted(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    for i, gone in plain_pairs(list(rows.items())).items():
        assert got[i] == (len(gone), "\n".join(x for k, x in enumerate(rows[i].split("\n")) if k not in gone))


def test_dotted_names(spark):
    docs = spark.createDataFrame([(1, "a" * 60, 5), (2, "a" * 60, 6)], ["doc_id", "text", "a.b"])
    got = ld.deduplicate(docs)
    assert got.columns == ["doc_id", "text", "a.b", "n_removed_lines"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a" * 60, 5, 0), (2, "", 6, 1)]
    assert ld.deduplicate(docs.limit(0)).collect() == []
