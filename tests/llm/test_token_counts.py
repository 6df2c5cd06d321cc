import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loresift.llm.token_counts import counter, prefix_table, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = st.lists(
    st.sampled_from(["the", " ", "  ", "\n", "'s", "'re", "Ünïcode", "42", "!!", "<|endoftext|>", " ", "\t", "日本", "a'll"])
    | st.text(max_size=3)
).map("".join)


def n(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_table_agrees_with_the_library(text):
    c = counter(PATH)
    ends, counts = c.table(text)
    assert (counts[-1] if len(counts) else 0) == n(text)
    assert (ends[-1] if len(ends) else 0) == len(text)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_every_prefix_is_exact(text):
    c = counter(PATH)
    table = c.table(text)
    for end in range(len(text) + 1):
        assert c.prefix_count(text, table, end) == n(text[:end]), (text, end)


def test_longest_prefix_fits():
    c = counter(PATH)
    text = "one two three four five"
    table = c.table(text)
    assert n(text[: c.longest_prefix(text, table, 3)]) <= 3


def test_budgets_and_tables(spark):
    texts = ["one two three four five " * 60, "short", "", None, "x" * 3000, "  é  " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts(docs, PATH, 20).collect():
        text = texts[r.doc_id] or ""
        assert r.fit_tokens == n(text[: r.fit_chars]) <= 20 and r.over_limit == (n(text) > 20)
        assert r.over_limit or r.fit_chars == len(text)
    for r in docs.select("doc_id", prefix_table("text", PATH).alias("t")).collect():
        assert all(x.tokens == n((texts[r.doc_id] or "")[: x.end]) for x in r.t[:50])


@pytest.mark.parametrize("text,expected", [(None, (0, 0)), ("", (0, 0)), ("é", (2, 1))])
def test_query_rows(spark, text, expected):
    docs = spark.createDataFrame([(1, text, 7)], "doc_id long, text string, n_tokens int")
    row = token_counts(docs, PATH).first()
    assert (row.n_bytes, row.n_tokens, row.over_limit) == (*expected, False)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_very_long_text_and_repeats(spark):
    text = "word and more \n" * 20_000
    docs = spark.createDataFrame([(1, text), (1, text), (None, "x")], "doc_id long, text string")
    rows = token_counts(docs, PATH).collect()
    assert {r.n_tokens for r in rows if r.doc_id == 1} == {n(text)}
