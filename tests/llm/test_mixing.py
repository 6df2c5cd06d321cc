import random

import duckdb
import pytest

from loresift.llm import mixing
from loresift.llm.mixing import mix, mixed_documents

SCHEMA = "doc_id long, text string, source string, size int"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def shared_out(sizes):
    """Targets by sharing the excess again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randrange(60))), rng.choice(["a", "b", "c", "B", None, "é"])) for i in range(200)]
    rows += [(900, None, "a"), (901, "", "b"), (None, "x y", "a"), (902, "only one here", "z"), (903, "  ", "empty"), (5, "w w", "a")]
    got = mix(rows_of(spark, rows)).collect()
    sizes, taken = {}, {}
    for r in got:
        assert r.size == len((r.row.text or "").split()) and 0 <= r.epochs * r.size + r.part <= 2 * r.size
        sizes[r.row.source] = sizes.get(r.row.source, 0) + r.size
        taken[r.row.source] = taken.get(r.row.source, 0) + r.epochs * r.size + r.part
    wanted = shared_out(sizes)
    for r in got:
        assert r.source_size == sizes[r.row.source] and abs(r.target - wanted[r.row.source]) < 1e-6
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    docs = mixed_documents(rows_of(spark, rows))
    assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    words = {}
    for r in docs.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_reruns_agree_and_empty_table(spark):
    rows = [(i, "a b c d", "s") for i in range(50)]
    one, two = (sorted(tuple(x for x in r if not isinstance(x, tuple)) for r in mix(rows_of(spark, rows)).drop("row").collect()) for _ in range(2))
    assert one == two
    assert mix(rows_of(spark, [])).count() == 0


def test_sql_form(spark):
    con = duckdb.connect()
    con.sql("create table documents as select * from (values (1, 'a b', 'x'), (2, null, null), (3, 'c', 'y')) t(doc_id, text, source)")
    assert con.sql(mixing.ORACLE).fetchall()
