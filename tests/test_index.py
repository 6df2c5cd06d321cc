import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loresift.functions.text import EOS, tokens
from loresift.operators import match
from loresift.operators.index import CorpusIndex
from loresift.plans import catalogue
from loresift.plans.search import build_corpus

SAMPLE = [
    ("doc1", "Doc 1", "This is a sample document"),
    ("doc2", "Doc 2", "This is another sample document"),
    ("doc3", "Doc 3", "And here you find the final one"),
]


@pytest.fixture(scope="module")
def sample(spark):
    return CorpusIndex.build(build_corpus(spark.createDataFrame(SAMPLE, "id string, title string, text string")))


def keys(spark, *ngrams):
    return match.as_keys(spark.createDataFrame([(g,) for g in ngrams], "ngram string"))


def test_lengths_and_beginnings(sample):
    rows = {r.doc: (r.length, r.beginning) for r in sample.beginnings().collect()}
    assert rows == {"doc1": (9, 0), "doc2": (9, 9), "doc3": (11, 18)}
    assert sample.n_tokens() == 29
    assert {r.doc: r.doc_idx for r in sample.numbered().collect()} == {"doc1": 0, "doc2": 1, "doc3": 2}


def test_counts_and_places(spark, sample):
    found = sample.occurrences(keys(spark, "This is", "sample document", "@@", EOS, "fantasy"))
    at = {(r.ngram, r.doc, r.pos) for r in found.collect()}
    assert {x for x in at if x[0] == "This is"} == {("This is", "doc1", 3), ("This is", "doc2", 3)}
    assert {x for x in at if x[0] == "sample document"} == {("sample document", "doc1", 6), ("sample document", "doc2", 6)}
    counts = {r.ngram: r["count"] for r in sample.counts(keys(spark, "@@", EOS, "fantasy")).collect()}
    assert counts == {"@@": 3, EOS: 3}


def test_titles(spark, sample):
    counts = {r.ngram: r["count"] for r in sample.counts(keys(spark, f"{EOS} Doc", f"{EOS} Doc 3 @@"), titles=True).collect()}
    assert counts == {f"{EOS} Doc": 3, f"{EOS} Doc 3 @@": 1}


def test_continuations(spark, sample):
    got = {(r.ngram, r.next): r["count"] for r in sample.continuations(keys(spark, "This is", "Doc", "sample document")).collect()}
    assert got == {("This is", "a"): 1, ("This is", "another"): 1, ("Doc", "1"): 1, ("Doc", "2"): 1, ("Doc", "3"): 1, ("sample document", EOS): 2}


def test_document_at_and_extract(spark, sample):
    at = spark.createDataFrame([(0,), (8,), (9,), (28,), (29,)], "at long")
    assert {(r["at"], r.doc, r.pos) for r in sample.document_at(at).collect()} == {(0, "doc1", 0), (8, "doc1", 8), (9, "doc2", 0), (28, "doc3", 10)}
    whole = {r.doc: r.toks for r in sample.extract().collect()}
    assert whole == {r.doc: r.toks for r in sample.docs.collect()}


def test_save_and_load(spark, sample, tmp_path):
    sample.save(str(tmp_path / "index"))
    saved = CorpusIndex.load(spark, str(tmp_path / "index"))
    assert saved.n_tokens() == 29
    asked = keys(spark, "This is", "This is a", "sample document </s>", "@@", "fantasy", "is This")
    rows = lambda index: sorted(map(tuple, index.occurrences(asked).collect()))
    assert rows(saved) == rows(sample) and len(rows(saved)) == 8
    assert sorted(map(tuple, saved.vocabulary().collect())) == sorted(map(tuple, sample.vocabulary().collect()))
    assert sorted(map(tuple, saved.token_counts().collect())) == sorted(map(tuple, sample.token_counts().collect()))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=5),
    st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=4), min_size=1, max_size=5),
)
def test_both_plans_find_what_a_scan_finds(spark, docs, wanted):
    index = CorpusIndex.build(spark.createDataFrame(list(enumerate(docs)), "doc long, toks array<string>"))
    expected = sorted(
        (" ".join(k), d, i)
        for k in {tuple(w) for w in wanted}
        for d, toks in enumerate(docs)
        for i in range(len(toks) + 1)
        if [*toks, EOS][i : i + len(k)] == list(k)
    )
    asked = keys(spark, *[" ".join(w) for w in wanted])
    for found in (match.by_explosion(index.docs, asked), match.by_rarest_token(index.docs, asked)):
        assert sorted((r.ngram, r.doc, r.pos) for r in found.collect()) == expected


def test_tokens_of_blank_text(spark):
    row = spark.createDataFrame([("  \n",), (" A\tb ",)], "t string").select(tokens("t").alias("t")).collect()
    assert [r.t for r in row] == [[], ["a", "b"]]


def test_integer_sequences(spark):
    index = CorpusIndex.build(spark.createDataFrame([(1, [7, 8, 7])], "doc long, toks array<int>"))
    assert {r.token: r.cf for r in index.vocabulary().select("token", "cf").collect()} == {"7": 2, "8": 1, EOS: 1}
    assert index.postings().where(F.col("token") == "7").count() == 2


def counting(spark, rows, schema="doc long, toks array<string>"):
    """A table, and an accumulator of how many of its rows were worked out."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def see(_):
        seen.add(1)
        return True

    return spark.createDataFrame(rows, schema).where(see.asNondeterministic()(F.col("doc"))), seen


def test_rarest_token_plan_works_out_documents_once(spark):
    docs, seen = counting(spark, [(k, ["a", "b", "c", EOS]) for k in range(5)])
    found = match.by_rarest_token(docs, keys(spark, "a b c", "b a"))
    assert found.count() == 5
    assert seen.value == 5


def test_documents_of_title_starts_are_worked_out_once(spark, monkeypatch):
    docs, seen = counting(spark, [(k, ["a", "b", "c"]) for k in range(5)])
    monkeypatch.setattr(catalogue, "corpus", lambda spark, sf_dir: docs)
    assert [tuple(r) for r in catalogue.title_prefix_match(spark, "").collect()] == [(f"{EOS} a b", 5)]
    assert seen.value == 5


def test_counts_of_all_runs_look_no_key_up(spark, monkeypatch):
    index = CorpusIndex.build(spark.createDataFrame([(1, list("abab")), (2, list("ba")), (3, ["a"])], "doc long, toks array<string>"))
    expected = {"a b": 2, "b a": 2}
    pairs = match.runs(index.docs, [2]).where(~F.col("ngram").endswith(EOS))
    assert {r.ngram: r["count"] for r in index.counts(match.as_keys(pairs)).collect()} == expected
    monkeypatch.setattr(match, "occurrences", None)
    rows = index.docs.select("doc", F.posexplode("toks").alias("pos", "token")).where(F.col("token") != EOS)
    found = match.run_counts(rows.orderBy(F.desc("pos")), "doc", ["pos"], "token", 2)
    assert {r.ngram: r["count"] for r in found.collect()} == expected
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_windows_cross_pieces(spark, monkeypatch):
    monkeypatch.setattr(match, "PIECE", 3)
    toks = [f"t{k}" for k in range(8)]
    docs = spark.createDataFrame([(1, toks)], "doc long, toks array<string>")
    rows = sorted((r.pos, r.t1, r.t2, r.t3) for r in match.windows(docs, 3, EOS).collect())
    padded = [EOS, *toks, None, None]
    assert rows == [(k - 1, *padded[k : k + 3]) for k in range(9)]


def test_texts_are_left_out_only_if_cleaning_leaves_nothing(spark):
    texts = [" \t\n", "BULLET::::", "SECBULLET::::TION::::", "BULSECTION::::LET::::", "TION", "a\u00a0\r\n b", "x \x0b\f y", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("title", F.lit("t"))
    got = {r.doc: (r.text, r.toks) for r in build_corpus(rows, include_title=False, lowercase=True).collect()}
    assert got == {3: ("BULLET::::", ["bullet::::"]), 4: ("TION", ["tion"]), 5: ("a\u00a0 b", ["a\u00a0", "b"]), 6: ("x y", ["x", "y"])}
