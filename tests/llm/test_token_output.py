import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loresift.llm import batch
from loresift.llm.pieces import WordPieces
from loresift.llm.token_output import digest, pack, unpack

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = WordPieces(PATH, most=200)


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=20)))
def test_round_trip(rows):
    counts = np.array([len(r) for r in rows], np.int64)
    values = np.array([v for r in rows for v in r], "<u4")
    (control, controls), (data, lengths) = pack(values, counts)
    assert (controls.sum(), lengths.sum()) == (len(control), len(data))
    assert unpack(control, data, counts).tolist() == values.tolist()


PARTS = ["The", " ", "\n", "'S", "É", "é", "́", "İ", "Σ", "42", "!!", "×", "ƺ", "ƻ", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\x1c", " ", "l'"]
TEXTS = st.lists(st.sampled_from(PARTS) | st.text(max_size=3)).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_ids_agree_with_the_library(texts):
    got = []
    for octets, ends in batch.slices(pa.array([t.encode() for t in texts], pa.binary()), 16):
        ids, counts = ENCODER.ids(octets, ends)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_digest(spark):
    rows = [(3, "One two"), (1, None), (2, ""), (None, "x"), (3, "One two"), (7, "many words here " * 5000)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, ids int")
    got = sorted(digest(docs, PATH).collect(), key=lambda r: r.start)
    start = 0
    for r, (doc_id, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_table(spark):
    assert digest(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
