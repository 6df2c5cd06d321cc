import hashlib
import random
import re

from hypothesis import given
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from loresift.llm import batch
from loresift.llm.decontaminate import GRAM, WINDOW, WORD, scan, words_of


def brute(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc_id, text in docs:
        w, hit, ids = split(text), set(), set()
        for item, item_text in items:
            v = split(item_text)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids.add(str(item))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "Beta", "gamma's", "d-e", "été", "42", "it"]
    make = lambda n: rng.choice([" ", "\n", "; "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.randrange(10, 30))) for i in range(12)] + [(50, make(4)), (51, "alone"), (52, None), (53, ""), (54, "!!"), (1, make(12))]
    docs = [(i, " ".join([make(rng.randrange(30)), (items[i % 14][1] or "")[: rng.randrange(10, 200)], make(rng.randrange(20))])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, items[3][1].upper()), (102, items[3][1].upper()), (None, items[4][1]), (103, "filler word " * 20_000 + items[5][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in scan(df, bench).collect()), key=str)
    assert got == brute(docs, items)
    assert scan(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in scan(df, bench.limit(0)).collect())


@given(st.lists(st.lists(st.integers(0, 5), max_size=30), max_size=5), st.integers(1, 3), st.integers(1, 8))
def test_every_window_keeps_its_least(rows, k, w):
    words = np.array([x for r in rows for x in r], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    grams = batch.gram_hashes(words, k)
    kept = batch.winnow(grams, first, k, w).tolist()
    expected = set()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        last = b - k
        for i in range(a, max(last - w + 2, a + 1)):
            window = range(i, min(i + w, last + 1))
            if window:
                expected.add(max(p for p in window if grams[p] == min(grams[q] for q in window)))
    assert kept == sorted(expected)


@given(st.lists(st.text(alphabet="aB9 -é\n")))
def test_words_and_hashes_of_a_batch(texts):
    for octets, ends in batch.slices(pa.array(["dropped", *texts], pa.string())[1:].cast(pa.binary()), 1 << 30):
        words = batch.Words(octets, ends, WORD)
        split = [words_of(t.encode()) for t in texts]
        assert np.diff(words.first).tolist() == list(map(len, split))
        assert words.hashes().tolist() == batch.word_hashes([w for s in split for w in s]).tolist()


def test_hashes_are_of_words():
    a, b = batch.word_hashes(words_of("The cat's 9 été".encode())), batch.word_hashes(words_of("9 ÉTÉ the cat été S".encode()))
    assert a.tolist() == [b[2], b[3], b[5], b[0], b[4]] and WINDOW - GRAM + GRAM == 10
