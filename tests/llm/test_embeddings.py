import numpy as np
from pyspark.sql import functions as F

from loresift.llm import embeddings
from loresift.llm.embeddings import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, rep string"


def brute(rows):
    ok = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    ids = [r[0] for r in rows]
    root, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ok):
        for b in ok[:k]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    p, q = sorted((find(a[0]), find(b[0])))
                    root[q] = p
    return sorted((i, n[i], find(i), find(i) == i) for i in ids)


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = []
    for i in range(300):
        v = base[i % 40] + rng.standard_normal(16) * rng.choice([0, 0.05, 0.14, 0.18])
        rows.append((i, [float(x) for x in v], int(i % 40 % 3), "x"))
    rows += [(400 + i, [1.0, 2.0, 3.0], 1, "x") for i in range(90)]
    rows += [
        (900, None, 1, "x"), (901, [0.0] * 16, 1, "x"), (902, [1.0, None], 1, "x"), (903, [float("nan"), 1.0], 1, "x"),
        (904, [float("inf"), 1.0], 1, "x"), (905, [1.0, 2.0, 3.0], None, "x"), (906, [], 1, "x"), (907, [2.0, 4.0, 6.0], 1, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (1024, 5):
        monkeypatch.setattr(embeddings, "CHUNK", chunk)
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect())
        assert got == brute(rows)


def test_empty_table_and_null_id(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    row = near_duplicates(spark.createDataFrame([(None, [1.0], 1, "x")], SCHEMA)).first()
    assert (row.vec_id, row.n_links, row.component_id, row.kept) == (None, 0, None, True)
