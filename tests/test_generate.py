import hashlib
import math

from pyspark.sql import functions as F

from loresift.operators import generate as generate_module
from loresift.operators.generate import BeamOptions, generate


def test_any_token_can_be_sampled(spark):
    cf = {f"t{k:03}": 3 if k < 20 else 1 for k in range(700)}
    counts = spark.createDataFrame(list(cf.items()), "token string, cf long")
    queries = spark.createDataFrame([(q, ["t001", "t699"]) for q in range(20)], "query long, toks array<string>")
    total = float(sum(cf.values()))
    got = generate(queries, None, counts, F.lit(total), BeamOptions(length=1, beam=3, sample="s")).collect()
    expected = set()
    for q in range(20):
        ranked = []
        for t, c in cf.items():
            u = max(int(hashlib.md5(f"s|{q}|1|ngram_||{t}".encode()).hexdigest()[:8], 16) / 4294967296.0, 1e-9)
            lp = math.log(((t in ("t001", "t699")) + 10.0 * c / total) / 12.0)
            ranked.append((-round(lp - math.log(-math.log(u)), 9), t))
        expected |= {(q, t, r) for r, (_, t) in enumerate(sorted(ranked)[:6], 1)}
    assert {(r.query, r.ngram, r["rank"]) for r in got} == expected


def test_documents_are_read_for_beams_of_one_and_two_tokens_only(spark):
    docs = spark.createDataFrame([(k, f"a b c d e f {k} </s>".split()) for k in range(3)], "doc long, toks array<string>")

    class Index:
        reads = 0

        @property
        def docs(self):
            self.reads += 1
            return docs

    index = Index()
    counts = docs.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count("*").alias("cf"))
    queries = spark.createDataFrame([(1, ["a", "b"])], "query long, toks array<string>")
    got = generate(queries, index, counts, F.lit(24.0), BeamOptions(length=6, beam=2)).collect()
    assert "a b c d e f" in {r.ngram for r in got}
    assert index.reads == 2


def test_followers_of_little_use_are_left_out_before_beams_meet_them(spark):
    followers = spark.createDataFrame([("a", f"t{k:03}", 1 + (k == 500)) for k in range(600)], "ngram string, next string, cf long")
    beams = spark.createDataFrame([(q, "a", 1, -1.0) for q in range(3)], "query long, ngram string, n int, lp double")
    own = spark.createDataFrame([(1, "t599", 1, 1)], "query long, next string, tf long, cf long")
    got = {(r.query, r.next) for r in generate_module._likely(beams, followers, own, 4).collect()}
    assert got == {(q, t) for q in range(3) for t in ("t500", "t000", "t001", "t002")} | {(1, "t599")}
