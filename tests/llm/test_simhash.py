import random

import numpy as np
import pytest
import xxhash

from loresift.llm import simhash
from loresift.llm.simhash import CHUNK, RADIUS, fingerprint, kept, links, near_duplicates


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= RADIUS:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_by_definition():
    for text in ["", "  \n", "One", "a B c d", "x y z w v \x0b u", "É\x1ca b  c " * 50, "the cat sat on the mat " * 9]:
        assert fingerprint(text.encode()) == slow_fingerprint(text), text


def edges_components(n, edges):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_links_join_what_all_near_pairs_join(spark, monkeypatch):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for base in [rng.getrandbits(64) for _ in range(6)]:
        fps |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(60)}
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "rep long, fp long")
    expected = brute_components(fps)
    for chunk, small in ((CHUNK, simhash.SMALL_GROUP), (40, 3)):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        monkeypatch.setattr(simhash, "SMALL_GROUP", small)
        found = [(r.a, r.b) for r in links(df).collect()]
        assert edges_components(len(fps), found) == expected
    for n in (10, 10**5, 10**7, 10**9):
        monkeypatch.setattr(simhash, "_blocks", lambda _, radius, b=simhash._blocks(n, RADIUS): b)
        assert edges_components(len(fps), [(r.a, r.b) for r in links(df).collect()]) == expected
        monkeypatch.undo()


def test_no_join_sends_keys_or_many_edges_to_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.getrandbits(63)) for i in range(0, 8000, 2)]
    rows += [(i + 1, fp ^ 1 << rng.randrange(63)) for i, fp in rows]
    stored, plans = simhash.store.materialize, []

    def watched(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, tag)

    prints = stored(spark.createDataFrame(rows, "doc_id long, fp long"), "prints")
    monkeypatch.setattr(simhash.store, "materialize", watched)
    monkeypatch.setattr(simhash.store, "SMALL_BYTES", 1000)
    got = {r.doc_id: r.component_id for r in simhash.assign(prints).collect()}
    assert got == {i: i - i % 2 for i in range(8000)}
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)


def forest(values, side):
    table = np.bitwise_count(values[:, None] ^ simhash._pivots()[None, :]).astype(np.int8)
    return simhash._forest(values, table, side, RADIUS)


@pytest.mark.parametrize("n", [600, 2048, 5000])
def test_forest_of_large_groups_in_any_order(n):
    rng = random.Random(n)
    centre = rng.getrandbits(64)
    ball = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(n // 2)]
    fps = list(dict.fromkeys(bridged(rng, n) + ball))[-n:]
    near = np.array(fps, np.uint64)
    edges = [(i, j) for i in range(n) for j in np.flatnonzero(np.bitwise_count(near[: i + 1] ^ near[i]) <= RADIUS).tolist() if j < i]
    expected = edges_components(n, edges)
    for _ in range(3):
        order = np.array(rng.sample(range(n), n))
        found = [(int(order[a]), int(order[b])) for a, b in forest(near[order], np.full(n, -1))]
        assert edges_components(n, found) == expected


def test_pivot_rows(spark):
    fps = [0, 1, 2**63 - 1, -1, -(2**63), 123456789]
    rows = spark.createDataFrame([(f,) for f in fps], "fp long").select("fp", *simhash.pivot_row("fp")).toArrow()
    table = np.bitwise_count(rows["fp"].to_numpy().view(np.uint64)[:, None] ^ simhash._pivots()[None, :])
    assert (simhash._table(rows) == table).all()


def bridged(rng, fillers):
    """Distinct fingerprints of one key: far ends first, what alone joins them last; links differ in 4 of the 5 blocks."""
    low, edges = rng.getrandbits(12), [12, 25, 38, 51, 64]

    def moved(fp):
        return fp ^ sum(1 << rng.randrange(a, b) for a, b in zip(edges, edges[1:], strict=False))

    def other():
        return rng.getrandbits(52) << 12 | low

    ends, between = [], []
    for k in range(80):
        a = other()
        r = moved(a)
        chain = [r, moved(r)] if k % 2 else [r]
        ends += [a, moved(chain[-1])]
        between += chain
    return list(dict.fromkeys(ends + [other() for _ in range(fillers)] + between))


def test_forest_joins_what_all_near_pairs_of_a_large_group_join(spark, monkeypatch):
    rng = random.Random(11)
    fps = bridged(rng, 1500)
    n, values = len(fps), np.array(fps, np.uint64)
    assert n > 1500 and brute_components(fps) == edges_components(n, forest(values, np.full(n, -1)))
    side = np.array([rng.randrange(2) for _ in fps])
    across = [(i, j) for i in range(n) for j in range(i) if side[i] != side[j] and (fps[i] ^ fps[j]).bit_count() <= RADIUS]
    assert edges_components(n, across) == edges_components(n, forest(values, side))
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values.view(np.int64))], "rep long, fp long")
    for chunk in (CHUNK, 700):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert edges_components(n, [(r.a, r.b) for r in links(df).collect()]) == brute_components(fps)


def test_rows(spark):
    base = [f"w{i}" for i in range(400)]
    near = [*base[:200], "other", *base[201:]]
    rows = [
        (5, " ".join(base), "x"), (3, " ".join(near), "x"), (9, " ".join(base).upper(), "y"), (7, "", "x"), (8, None, None),
        (None, " ".join(base), "x"), (None, "quite another text", "x"), (11, "alone in the world", "x"), (11, "alone in the world", "x"),
        (12, "very long text " * 100_000 + "end", "x"), (13, "very long text " * 100_000 + "end", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in near_duplicates(docs).collect())
    assert brute_components([slow_fingerprint(r[1]) for r in rows])[1] == 0
    assert got == [(-1, -1), (-1, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 3), (11, 11), (11, 11), (12, 12), (13, 12)]
    stay = kept(docs)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in stay.collect()) == [-1, 3, 7, 11, 12]


def test_kept_rows_are_not_moved(spark):
    """Over 32,768 rows of one partition, copies of them in another: every row that stays stays once, whichever partition it is in, and no text is shuffled."""
    spark.range(0, 40_000, 1, 1).union(spark.range(0, 40_000, 7, 3)).union(spark.range(39_990, 40_050, 1, 2)).createOrReplaceTempView("ids")
    docs = spark.sql("select id as doc_id, concat(id, ' is a number of its own ', hash(id), ' ', hash(id, 1), ' ', hash(id, 2)) as text, id % 3 as fp from ids")
    stay = kept(docs)
    plan = stay._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan
    got = sorted((r.doc_id, r.text, r.fp) for r in stay.collect())
    component = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == sorted((r.doc_id, r.text, r.fp) for r in docs.distinct().collect() if component[r.doc_id] == r.doc_id)
    assert len(got) > 35_000


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0 and kept(docs).count() == 0
