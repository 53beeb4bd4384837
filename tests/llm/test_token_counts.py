from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import common, token_counts
from tests.llm import cases


def whole(path):
    """The library over whole texts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


def files():
    import public_tokenizers

    return [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")]


@pytest.mark.parametrize("path", files())
def test_counts(spark, path):
    got = token_counts.count_tokens(cases.documents(spark), tokenizer=path, limit=200).collect()
    size = whole(path)
    want = Counter()
    for i, t in cases.rows():
        n = size(t or "")
        want[i, len((t or "").encode()), n, n > 200] += 1
    assert Counter(map(tuple, got)) == want


def test_query_on_a_given_table(spark):
    from scriptorium.llm.queries import op11_token_counts

    size = whole(token_counts.default_tokenizer())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), size(r.text or ""), size(r.text or "") > 1024) for r in docs)
    assert Counter(map(tuple, op11_token_counts(spark, "/root/testdata/sf0.001").collect())) == want


TRICKY = "a b  c\t d\n e \n\nf 's it's  don't <|endoftext|> x<|endoftext|> <|endoftext|>y  <|endoftext|> z   q  é 12 3a, ... !? <|ENDOFTEXT|>\r\n \x1c a \u0085 b \x0b"


@pytest.mark.parametrize("text", [TRICKY, " " + TRICKY + " ", TRICKY * 9, "x" * 200_000, "  " * 1000, "ab " * 50_000, "﻿ a", "日本 語 テキスト 🙂 🙂🙂"])
def test_cutting_at_blanks_changes_nothing(text):
    path = token_counts.default_tokenizer()
    assert token_counts.Counter(path, known=3).of(text) == whole(path)(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t  a'sé1.<|>endoftx　\x1f", max_size=60))
def test_any_text(text):
    path = token_counts.default_tokenizer()
    assert token_counts._counter(path).of(text) == _whole()(text)


_kept = []


def _whole():
    if not _kept:
        _kept.append(whole(token_counts.default_tokenizer()))
    return _kept[0]


def test_the_cache_is_used_and_grows(spark, monkeypatch):
    cache, path = common.scratch(spark, "cache"), token_counts.default_tokenizer()
    docs = cases.documents(spark)
    distinct = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    _, n = token_counts.fill(docs, cache, path)
    assert n == distinct
    first = token_counts.count_tokens(docs, cache, path).collect()
    # a count that only the cache can have given
    own = token_counts.version(path)
    spark.createDataFrame([(docs.select(F.unhex(F.sha2(F.lit("brand new"), 256))).first()[0], 77, own), (b"other", 5, "another tokenizer")], token_counts.CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(900, "brand new"), (901, "quite another"), (902, "quite another")], "doc_id long, text string"))
    for rows in (token_counts.BROADCAST_ROWS, 0):  # few missing, many missing
        monkeypatch.setattr(token_counts, "BROADCAST_ROWS", rows)
        other = common.scratch(spark, "cache")
        spark.read.parquet(cache).write.partitionBy("tokenizer").parquet(other)
        counts, n = token_counts.fill(more, other, path)
        assert n == 1
        assert counts.count() == distinct + 2
        got = token_counts.count_tokens(more, other, path).collect()
        assert {r.doc_id: r.n_tokens for r in got if (r.doc_id or 0) >= 900} == {900: 77, 901: 2, 902: 2}
        assert Counter(r for r in got if (r.doc_id or 0) < 900) == Counter(first)
        assert token_counts.fill(more, other, path)[1] == 0
    # a run that repeats another's rows doesn't double the result
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(other)
    assert Counter(r for r in token_counts.count_tokens(more, other, path).collect()) == Counter(got)


def test_another_version_never_meets_these_counts(spark):
    a, b, _ = files()
    assert token_counts.version(a) != token_counts.version(b)
    cache = common.scratch(spark, "cache")
    docs = cases.documents(spark)
    token_counts.fill(docs, cache, a)
    size = whole(b)
    got = token_counts.count_tokens(docs, cache, b).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, size(t or "")) for i, t in cases.rows())


def test_empty(spark):
    assert token_counts.count_tokens(cases.empty(spark)).collect() == []
    odd = cases.documents(spark).withColumnsRenamed({"h": "digest", "pattern": "n_tokens"}).withColumn("a.b", F.lit(1))
    assert token_counts.count_tokens(odd).count() == len(cases.rows())
