import random

import corpus_pipeline
from loresift.llm.simhash import fingerprint


def test_stages_on_planted_documents(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    good = lambda: ". ".join(" ".join([word().capitalize(), *(word() for _ in range(8))]) for _ in range(25)) + "."
    junk = lambda: " ".join(word().upper() + rng.choice(["!!", "$$$", "###", "|"]) for _ in range(150))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, good(), "en", f"src{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, junk(), "en", f"src{i % 4}", 0) for i in range(40)]
    near = rows[7][1].split(" ")
    rows += [(200, rows[5][1], "en", "src0", 0), (201, rows[5][1].upper().lower(), "en", "src1", 0), (202, " ".join([*near[:40], "changed", *near[41:]]), "en", "src2", 0)]
    rows += [(300, good() + " " + passage + " " + good(), "en", "src0", 0), (400, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, int(i < 100), 0) for i, *_ in rows if i < 140]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
        assert k == 4 or docs.columns == columns
    assert not {i for i in ids[0] if i is not None and 100 <= i < 140} and set(range(60)) <= set(ids[0])
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    close = (fingerprint(texts[7]) ^ fingerprint(texts[202])).bit_count() <= 4
    assert {200, 201} & set(ids[1]) <= {201} and (202 in ids[1]) == (not close) and len(ids[1]) == len(set(ids[1]))
    assert set(range(60)) <= set(ids[1])
    assert set(ids[1]) - set(ids[2]) == {300}
    assert set(ids[4]) == set(ids[3]) <= set(ids[2]) and len(ids[4]) == len(ids[3])


def test_stages_on_odd_tables(spark, tmp_path):
    """Clashing names, repeated rows, nulls, a very long text; then the same with no rows at all."""
    extra = ["row", "fp", "score", "n_words", "before", "source_key", "component_id", "size", "key", "ids"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    texts = [f"The number {i} house. " + " ".join(f"Word{i}x{k} follows." for k in range(30)) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 2}", 0, *extra) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (50, None, None, None, None, *[None] * 10), (51, "", "en", "s1", 0, *extra), (None, "No id here at all.", "en", "s0", 0, *extra)]
    rows += [(60, "A long one. " + "It goes on and on. " * 50_000, "en", "s0", 0, *extra)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(0, "never seen words of a benchmark item that nobody holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (docs, docs.limit(0)):
        now = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, str(tmp_path))
            assert after.columns == docs.columns, name
            now = corpus_pipeline.store.materialize(after, "odd")
        found = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert len(found) == now.count()
        if some is docs:
            counts = {}
            for r in now.select("doc_id", "row", "ids").collect():
                counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
                assert r.doc_id == 50 or (r.row, r.ids) == ("row", "ids")
            assert {*range(12), 60} <= set(counts) and counts[3] <= 2
        else:
            assert not found
