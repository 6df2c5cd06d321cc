import math
import random

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loresift.functions import scoring
from loresift.operators import evidence
from loresift.operators.generate import BeamOptions, body_keys, code_keys, generate, title_keys
from loresift.operators.index import CorpusIndex
from loresift.operators import match
from loresift.functions.text import EOS
from loresift.operators.keys import CountScorer, score_unigrams
from loresift.plans.search import Options, Searcher


@pytest.mark.parametrize("lp,count,expected", [(-1.0, 2, 0.653837), (-0.5, 1, 3.893507), (-4.0, 3, 0.0), (-1.0, 0, 0.0)])
def test_key_score(spark, lp, count, expected):
    df = spark.createDataFrame([(lp, count, 1)], "lp double, count long, n int")
    got = df.select(scoring.key_score("lp", "count", "n", F.lit(29.0)).alias("s")).first().s
    assert math.isclose(got, expected, abs_tol=1e-6)


def sequential(hits, beta):
    """hits: [(ngram, score)] of one document, credited in order."""
    covered, out = set(), {}
    for ngram, score in sorted(hits, key=lambda h: (-h[1], h[0])):
        types = set(ngram.split(" "))
        out[ngram] = score * (1 - beta + beta * len(types - covered) / len(types))
        covered |= types
    return out


def test_discount_is_the_sequential_one(spark):
    hits = [("a b", 3.0), ("b c", 2.0), ("c", 2.0), ("a", 1.0), ("d d", 0.5)]
    df = spark.createDataFrame([(1, 7, g, s) for g, s in hits], "query long, doc long, ngram string, score double")
    got = {r.ngram: r.credit for r in evidence.discounted(df, Options(repetition_penalty=0.8)).collect()}
    for ngram, credit in sequential(hits, 0.8).items():
        assert math.isclose(got[ngram], credit, abs_tol=1e-9)


def test_greedy_takes_free_places_in_order(spark):
    rows = [(1, 1, "a b", 3.0, 0), (1, 1, "b c", 2.0, 1), (1, 1, "c", 1.0, 2), (1, 1, "a b", 3.0, 5), (1, 1, "c", 1.0, 6)]
    df = spark.createDataFrame(rows, "query long, doc long, ngram string, score double, pos int")
    got = {r.ngram: round(r.credit, 6) for r in evidence.greedy(df, Options(repetition_penalty=0.5)).collect()}
    assert got == {"a b": 3.0, "c": 1.0}


def test_stage_one_counts_keys_that_better_ones_leave_free(spark):
    rng = random.Random(3)
    rows = []
    for query in range(3):
        keys = {" ".join(rng.choices("abcd", k=rng.randrange(1, 4))): round(rng.random() * 5, 3) for _ in range(12)}
        for doc in range(8):
            toks = rng.choices("abcd", k=20)
            for key, score in keys.items():
                n = len(key.split())
                rows += [(query, doc, key, n, 1, score, i) for i in range(20 - n + 1) if " ".join(toks[i : i + n]) == key]
    at = spark.createDataFrame(rows, "query long, doc long, ngram string, n int, count long, score double, pos int")
    expected = {}
    for query, doc in {r[:2] for r in rows}:
        taken, counted = set(), {}
        for key, score, pos in sorted(((r[2], r[5], r[6]) for r in rows if r[:2] == (query, doc)), key=lambda r: (-r[1], r[0], r[2])):
            places = set(range(pos, pos + len(key.split())))
            if not places & taken:
                taken |= places
                counted[key] = score
        expected[query, doc] = round(sum(sequential(list(counted.items()), 0.8).values()), 6)
    # each query has keys of its own: scores go with (query, key)
    hits = at.select("query", "doc", "ngram", "n", "count", "score", "pos")
    free = evidence.free_keys(hits)
    got = evidence.discounted(free, Options()).groupBy("query", "doc").agg(F.sum("credit").alias("s"))
    assert {(r.query, r.doc): round(r.s, 6) for r in got.collect()} == expected


def test_unigrams_without_corpus_frequencies(spark):
    unigrams = spark.createDataFrame([(1, "a", 5, -1.0), (1, "b", 5, -2.5), (1, "c", 5, -4.0)], "query long, token string, cf long, lp double")
    keys_ = spark.createDataFrame([(1, "x y", 2, -3.0)], "query long, ngram string, n int, lp double")
    got = score_unigrams(unigrams, keys_, F.lit(100.0), Options(use_index_frequency=False)).collect()
    assert {r.token: round(r.score, 6) for r in got} == {"a": round(2.1**2, 6), "b": round(0.6**2, 6)}


def test_temperature_of_unigrams(spark):
    docs = CorpusIndex.build(spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["c"])], "doc long, toks array<string>"))
    queries = spark.createDataFrame([(1, ["a", "b"])], "query long, toks array<string>")
    counts, total = docs.token_counts(), docs.n_tokens()
    got = {r.token: r.lp for r in CountScorer(mu=2.0, temperature=2.0, banned=("c",)).unigrams(queries, counts, F.lit(float(total))).collect()}
    p = {t: (tf + 2 * cf / total) / 4 for t, tf, cf in (("a", 1, 2), ("b", 1, 1), (EOS, 0, 2))}
    z = sum(x**0.5 for x in p.values())
    assert {t: round(v, 6) for t, v in got.items()} == {t: round(math.log(p[t] ** 0.5 / z), 6) for t in ("a", "b")}


@pytest.fixture(scope="module")
def small(spark):
    docs = [(1, "the cat sat on the mat".split()), (2, "the dog sat on the log".split()), (3, "a bird flew over the mat".split())]
    return CorpusIndex.build(spark.createDataFrame(docs, "doc long, toks array<string>"))


def test_search_ranks_the_document_with_the_evidence_first(spark, small):
    queries = spark.createDataFrame([(1, "dog log".split()), (2, "bird over".split())], "query long, toks array<string>")
    got = Searcher(small, Options(smoothing=1.0)).search(queries, 2).where("rank = 1").collect()
    assert {(r.query, r.doc) for r in got} == {(1, 2), (2, 3)}


def test_every_generated_key_occurs(spark, small):
    queries = spark.createDataFrame([(1, "cat mat".split())], "query long, toks array<string>")
    counts, total = small.token_counts(), F.lit(float(small.n_tokens()))
    for options in (BeamOptions(length=3, beam=3), BeamOptions(length=2, beam=4, groups=2, diversity=1.0), BeamOptions(length=2, beam=3, sample="s")):
        keys = generate(queries, small, counts, total, options)
        found = small.counts(match.as_keys(keys)).select("ngram")
        assert keys.count() > 0 and keys.join(found, "ngram", "left_anti").count() == 0


def test_titles_codes_and_bodies_in_one_search(spark):
    rows = [(1, "cats @@ the cat sat || c1 ||".split()), (2, "dogs @@ the dog ran || c2 ||".split()), (3, "big dogs @@ a dog slept || c2 ||".split())]
    index = CorpusIndex.build(spark.createDataFrame(rows, "doc long, toks array<string>"))
    queries = spark.createDataFrame([(1, "dogs c2".split())], "query long, toks array<string>")
    options = Options(generate_keys=True, length=2, decode_titles=True, decode_code=True, smoothing=1.0)
    found, _ = Searcher(index, options).generate_keys(queries)
    keys_ = {r.ngram for r in found.collect()}
    assert {f"{EOS} dogs @@", "|| c2 ||", "dogs", "c2"} <= keys_ and f"{EOS} dogs" not in keys_ and "|| c2" not in keys_ - {"|| c2"}
    assert all(k.endswith("@@") for k in keys_ if k.startswith(EOS))
    partial, _ = Searcher(index, replace(options, partial_titles=True, partial_code=True)).generate_keys(queries)
    assert f"{EOS} dogs" in {r.ngram for r in partial.collect()}
    asked = Searcher(index, options).prompted(queries, "code").first().prompt
    assert asked == " dogs c2 || code || +"
    top = Searcher(index, options).search(queries, 1).first()
    assert top.doc == 2
    assert Searcher(index, options).parts(index.docs.where("doc = 3").select("doc")).first().title == ["big", "dogs"]


def test_rules_of_generated_keys(spark):
    made = spark.createDataFrame([(1, f"{EOS} x a @@"), (1, f"{EOS} x b"), (1, "x")], "query long, ngram string").withColumn("lp", F.lit(-1.0)).withColumn("n", F.lit(0))
    show = lambda df: sorted(r.ngram for r in df.collect())
    assert show(title_keys(made, EOS, "@@", forced_second=True)) == [f"{EOS} a @@"]
    assert show(title_keys(made, EOS, "@@", partial=True)) == [f"{EOS} x", f"{EOS} x a @@", f"{EOS} x b"]
    assert show(title_keys(made, EOS, "@@", exactly=2)) == [] and show(title_keys(made, EOS, "@@", exactly=3)) == [f"{EOS} x a @@"]
    assert show(body_keys(made)) == ["x", "x a @@", "x b"] and show(body_keys(made, 2)) == ["x b"]
    codes = spark.createDataFrame([(1, "|| y c1 ||"), (1, "|| c2")], "query long, ngram string").withColumn("lp", F.lit(-1.0)).withColumn("n", F.lit(0))
    assert show(code_keys(codes, "||", "||", forced_second=True)) == ["|| c1 ||"]
    assert show(code_keys(codes, "||", "||", partial=True)) == ["|| c2", "|| y c1 ||"]
