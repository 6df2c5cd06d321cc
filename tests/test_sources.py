import json
import math
from collections import Counter
from difflib import SequenceMatcher

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loresift.__main__ import main
from loresift.operators import training
from loresift.sources import readers, writers
from loresift.streaming.search import answer
from loresift.operators.index import CorpusIndex
from loresift.operators.keys import CountScorer
from loresift.plans.search import Options, Searcher
from loresift.functions.text import STOPWORDS, passage_parts, repair, split_at, strip_ends, words
from pyspark.sql import functions as F


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_corpus_readers(spark, tmp_path):
    path = write(tmp_path, "a.tsv", "1\tT\tx y\nbad\n2\tU\tz\twith tab\n")
    assert [tuple(r) for r in readers.corpus_tsv(spark, path).orderBy("id").collect()] == [("1", "T", "x y"), ("2", "U", "z\twith tab")]
    path = write(tmp_path, "b.tsv", 'id\ttext\ttitle\n1\t"say ""hi"""\tT\n2\tonly\n')
    assert [tuple(r) for r in readers.passages_tsv(spark, path).collect()] == [("1", "T", 'say "hi"')]
    path = write(tmp_path, "m.tsv", 'id\ttext\ttitle\n1\t"two\nlines"\tT\n')
    assert [tuple(r) for r in readers.passages_tsv(spark, path).collect()] == [("1", "T", "two\nlines")]


def test_topic_readers(spark, tmp_path):
    path = write(tmp_path, "t.json", json.dumps([{"question": "q one", "answers": ["a"]}, {"question": "q two", "answers": []}]))
    assert [(r.topic, r.query) for r in readers.topics(spark, path, "dpr").orderBy("topic").collect()] == [(0, "q one"), (1, "q two")]
    path = write(tmp_path, "t.tsv", "who\t['x', \"y\"]\n")
    assert [(r.topic, r.query, r.answers) for r in readers.topics(spark, path, "dpr_qas").collect()] == [(0, "who", ["x", "y"])]
    path = write(tmp_path, "t.jsonl", '{"example_id": 5, "question_text": "why"}\n')
    assert [tuple(r) for r in readers.topics(spark, path, "nq").collect()] == [("5", "why")]
    path = write(tmp_path, "k.jsonl", '{"id": "a", "input": "in", "meta": {"template_questions": ["tq", "other"]}}\n')
    assert [tuple(r) for r in readers.topics(spark, path, "kilt").collect()] == [("a", "in")]
    assert [tuple(r) for r in readers.topics(spark, path, "kilt_template").collect()] == [("a", "tq")]
    with pytest.raises(ValueError):
        readers.topics(spark, path, "other")


def test_training_readers(spark, tmp_path):
    path = write(tmp_path, "d.json", json.dumps([{"question": "q", "positive_ctxs": [{"title": "t", "text": "x", "score": 1000, "title_score": 1, "passage_id": "p"}]}]))
    assert [(r.sample, r["rank"], r.key) for r in readers.positive_contexts(spark, path).collect()] == [(0, 1, "p")]
    path = write(tmp_path, "p.jsonl", json.dumps({"input": " a\nb ", "output": [{"provenance": [{"wikipedia_id": "9", "start_paragraph_id": 2}]}, {"answer": "z"}]}) + "\n")
    assert [(r.question, r.key) for r in readers.provenance(spark, path).collect()] == [("a / b", "9-2")]
    left, right = write(tmp_path, "l.txt", "a\n\nc\n"), write(tmp_path, "r.txt", "x\ny\nz\n")
    assert sorted((r.source, r.target) for r in readers.parallel_lines(spark, left, right).collect()) == [("a", "x"), ("c", "z")]


def test_writers(spark, tmp_path):
    hits = spark.createDataFrame([(1, "7-2-3", 1, 2.5, "T", "x"), (1, "7-5", 2, 1.0, "T", "y"), (1, "8", 3, 0.5, "U", "z")], "query long, docid string, rank int, score double, title string, text string")
    topics = spark.createDataFrame([(1, "ask"), (2, "none")], "query long, input string")
    kilt = {r.query: json.loads(r.line) for r in writers.kilt_lines(hits, topics).collect()}
    assert kilt[1]["output"][0]["provenance"][0] == {"wikipedia_id": 7, "start_paragraph_id": 2, "end_paragraph_id": 3, "text": "T @@ x", "score": 2.5}
    assert kilt[2]["output"] == [{"provenance": []}]
    dpr = {r.query: json.loads(r.line) for r in writers.dpr_lines(hits, topics).collect()}
    assert [c["passage_id"] for c in dpr[1]["ctxs"]] == ["7-2-3", "7-5", "8"] and dpr[2]["ctxs"] == []
    assert [r.line for r in writers.trec_lines(hits).orderBy("rank").collect()][0] == "1 Q0 7-2-3 1 2.500000 loresift"
    pages = writers.limited(hits, 5, "-", max_passage=True).orderBy("rank").collect()
    assert [(r.docid, r["rank"]) for r in pages] == [("7", 1), ("8", 2)]
    for kind in writers.WRITERS:
        writers.write(hits, topics, str(tmp_path / kind), kind)
        assert spark.read.text(str(tmp_path / kind)).count() > 0


def test_text_functions(spark):
    df = spark.createDataFrame([("CafÃ©", "a,b", ["x", "@@", "y"], ["s", "s", "m", "e"], "12-3")], "t string, p string, d array<string>, e array<string>, id string")
    row = df.select(repair("t").alias("t"), words("p").alias("p"), split_at("d", "@@").alias("d"), strip_ends("e", ["s"], ["e"]).alias("e"), passage_parts("id").alias("id")).first()
    assert (row.t, row.p, row.d.title, row.d.body, row.e) == ("Café", "a , b", ["x"], ["y"], ["m"])
    assert (row.id.page, row.id.start, row.id.end) == ("12", 3, 3)


def slow_weights(question, passage, stop, words=3):
    """Likeness summed over the runs of the question, for every start of the passage that is not a stop word."""
    question = [w.lower() for w in (question[: question.index("||")] if "||" in question else question)]
    passage = [w.lower() for w in passage]
    out = {}
    for i in range(len(question)):
        for j in range(len(passage)):
            if passage[j] not in stop:
                a, b = " ".join(question[i : i + words]), " ".join(passage[j : j + words])
                out[j] = out.get(j, 0) + round(100 * SequenceMatcher(None, a, b).ratio()) / 100
    return out


def test_span_weights_and_samples(spark):
    rows = [
        (1, "old Red house || title".split(), "We saw the old red house there yes of".split()),
        (2, ["zzz"], ["the", "of"]), (3, ["q"], ["xy", "ww"]), (4, [], ["a", "b"]),
    ]
    pairs = spark.createDataFrame(rows, "pair long, question array<string>, passage array<string>")
    weights = training.span_weights(pairs)
    got = {}
    for r in weights.collect():
        got.setdefault(r.pair, {})[r.start] = (r.weight, r.p)
    expected = slow_weights(rows[0][1], rows[0][2], STOPWORDS)
    z = sum(math.exp(w) for w in expected.values())
    assert {k: (round(w, 6), round(p, 6)) for k, (w, p) in got[1].items()} == {k: (round(w, 6), round(math.exp(w) / z, 6)) for k, w in expected.items()}
    assert got[2] == {0: (None, 1.0)} and got[3] == {0: (0.0, 1.0)} and got[4] == {0: (None, 1.0)}
    drawn = training.sample_spans(weights, pairs, 5, "x", least=2, most=4).collect()
    counts = Counter(r.pair for r in drawn)
    assert counts == {1: 5, 2: 1, 3: 5, 4: 1}
    for r in drawn:
        passage = rows[r.pair - 1][2]
        assert r.span in {" ".join(passage[r.start : r.start + k]) for k in (2, 3, 4)}


def test_random_pairs_follow_their_rules(spark):
    toks = "The cat. (sat on mats, while dogs ran over hills and far away".split()
    rows = [(i, f"T{i}", " ".join(toks), toks) for i in range(40)] + [(90, "same", "same", ["same"]), (91, "t", "x", ["x"]), (92, "t", "the", ["the"])]
    docs = spark.createDataFrame(rows, "doc long, title string, text string, toks array<string>")
    lengths = training.Lengths((2, 4), (3, 3))
    got = training.random_pairs(docs, 3, "s", titles=2, lengths=lengths, pretraining=True).collect()
    starts = {" ".join(toks[i : i + 3]) for i in range(len(toks) - 2)}
    sources = {" ".join(toks[i : i + n]) for n in (2, 3, 4) for i in range(len(toks) - n + 1)}
    lower = {s.lower() for s in sources}
    assert max(Counter((r.doc, r.kind) for r in got).values()) == 3 and {r.kind for r in got} == {"body", "title"}
    for r in got:
        if r.doc >= 90:
            # one word: source and target start at one place, or on a bad word; only titles are left
            assert r.kind == "title" and r.doc != 90
            continue
        assert r.source.endswith(" || p")
        text, mark = r.source.removesuffix(" || p").rsplit(" || ", 1)
        if mark == "title":
            assert r.kind == "title" and r.target == f"T{r.doc} @@" and text in sources | lower
        else:
            assert r.target in starts and r.target.split()[0].lower() not in STOPWORDS and r.target[0] != "(" and not r.target.split()[0].endswith(".")
            assert text.lower() == f"t{r.doc}" if r.kind == "title" else text in sources | lower
            assert r.kind == "title" or text.lower().split()[0] != r.target.lower().split()[0]
    assert 0.02 < sum(r.source == r.source.lower() and r.source[0].isalpha() and r.kind == "title" and r.source.startswith("t") for r in got) / len(got) < 0.2


def test_lines_and_pair_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lines = spark.createDataFrame([("a b  ", "c"), (" ", "d"), ("é", None)], "source string, target string")
    got = sorted((r["filter"], r.source) for r in training.encoded_lines(lines, path).collect())
    library = Tokenizer.from_file(path)
    assert [g[0] for g in got] == ["EMPTY", "EMPTY", "PASS"] and got[2][1] == " ".join(map(str, library.encode("a b").ids))
    ids = spark.createDataFrame([(got[2][1],)], "line string")
    assert training.decoded_lines(ids, path).first().line == "a b"
    pairs = spark.createDataFrame([(f"s{i} ", f"t{i}") for i in range(50)], "source string, target string").repartition(3)
    writers.write_pairs(pairs, str(tmp_path / "train"), text=True)

    def read(side):
        return [x for f in sorted((tmp_path / f"train.{side}").glob("part-*")) for x in f.read_text().splitlines()]

    source, target = read("source"), read("target")
    assert sorted(source) == sorted(f" s{i}" for i in range(50)) and [s[2:] for s in source] == [t[2:] for t in target]
    writers.write_binarised(spark.createDataFrame([("train", "1 2", "3")], "split string, source string, target string"), str(tmp_path / "bin"))
    assert {(r.split, r.side, tuple(r.ids)) for r in spark.read.parquet(str(tmp_path / "bin")).collect()} == {("train", "source", (1, 2)), ("train", "target", (3,))}


def test_tables_of_codes_and_knowledge(spark, tmp_path):
    path = write(tmp_path, "codes.tsv", "a\tx1\n\nb\tx2\n")
    assert {tuple(r) for r in readers.codes(spark, path).collect()} == {("a", "x1"), ("b", "x2")}
    path = write(tmp_path, "kb.tsv", "1-2\tT\tbody\n2-1\t \tbody\n")
    assert [tuple(r) for r in readers.knowledge_base(spark, path).collect()] == [("1-2", "T", "body")]


def test_command_line(spark, tmp_path):
    corpus = write(tmp_path, "c.tsv", "d1\tCats\tthe cat sat on the mat\nd2\tDogs\tthe dog sat on the log\n")
    topics = write(tmp_path, "t.tsv", "q1\tdog log\nq2\tcat mat\n")
    main(["build", corpus, str(tmp_path / "index"), "--include_title", "--lowercase"])
    out = str(tmp_path / "run")
    main(["search", "--index", str(tmp_path / "index"), "--topics", topics, "--output", out, "--hits", "1", "--smoothing", "1.0", "--lowercase", "--decode_titles"])
    lines = sorted(r.value.split()[:4] for r in spark.read.text(out).collect())
    assert lines == [["q1", "Q0", "d2", "1"], ["q2", "Q0", "d1", "1"]]
    main(["search", "--index", str(tmp_path / "index"), "--topics", topics, "--output", out + ".json", "--output_format", "dpr", "--hits", "1", "--smoothing", "1.0", "--lowercase"])
    records = json.loads("".join(f.read_text() for f in sorted((tmp_path / "run.json").glob("part-*"))))
    assert [(r["question"], r["ctxs"][0]["title"]) for r in records] == [("dog log", "dogs"), ("cat mat", "cats")]


def test_stream_of_queries(spark, tmp_path):
    index = CorpusIndex.build(spark.createDataFrame([(1, ["cat", "mat"]), (2, ["dog", "log"])], "doc long, toks array<string>"))
    spark.createDataFrame([(5, "Dog log")], "query long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query long, text string").parquet(str(tmp_path / "in"))
    answer(stream, Searcher(index, Options(smoothing=0.5), CountScorer(mu=1.0)), 1, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select(F.col("query"), F.col("doc")).collect()
    assert [tuple(r) for r in got] == [(5, 2)]


def test_tokens_are_not_moved_for_draws(spark):
    docs = spark.createDataFrame([(1, "t", "a b", ["a", "b"])], "doc long, title string, text string, toks array<string>")
    pairs = training.random_pairs(docs, 2, "seed", titles=1)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :].splitlines()[1]
    assert "Project" in window and "toks#" not in window.split(" AS ")[-1] and not window.rstrip().endswith("...")
    assert "array_join(slice(toks" not in plan[: plan.index("Window")]
