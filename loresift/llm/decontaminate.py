"""Benchmark decontamination by winnowing.

Of the k-gram hashes of a text, the least in every window of w is kept, so that any two texts
sharing w + k - 1 consecutive words share a kept hash. Kept hashes of documents and benchmark
items are joined; every hit is extended to the item windows that can contain it, and these are
compared word for word. Items shorter than a window are kept whole (k their length, w = 1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresift.llm import batch, store

WINDOW = 10
GRAM = 5

WORD = bytes(
    b if b in range(0x30, 0x3A) or b in range(0x61, 0x7B) or b >= 0x80 else (b + 32 if b in range(0x41, 0x5B) else 0x20)
    for b in range(256)
)

def words_of(data: bytes) -> list[bytes]:
    """The words of a text in UTF-8: runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return data.translate(WORD).split()


def fingerprints(text: str, lengths: list[int], window: int = WINDOW, gram: int = GRAM) -> Column:
    """Array of (hash, at, length): winnowed grams as length ``window``, and every run of each short length."""
    kind = T.StructType([T.StructField("hash", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("length", T.IntegerType())])

    def compute(texts: pa.Array) -> pa.Array:
        counts, hashes, places, kinds = [], [], [], []
        for octets, ends in batch.slices(texts):
            words = batch.Words(octets, ends, WORD)
            h, first = words.hashes(), words.first
            found = []
            for length in [window, *lengths]:
                k = gram if length == window else length
                grams = batch.gram_hashes(h, k)
                at = batch.winnow(grams, first, k, window - gram + 1 if length == window else 1)
                found.append((at, grams[at] ^ np.uint64(length), np.full(len(at), length, np.int32)))
            at, hashed, length = map(np.concatenate, zip(*found, strict=True))
            row = batch.row_of(at, first)
            order = np.argsort(row, kind="stable")
            counts.append(np.bincount(row, minlength=words.rows))
            hashes.append(hashed[order])
            places.append((at - first[row])[order].astype(np.int32))
            kinds.append(length[order])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int32)
        flat = [np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.uint64, hashes), (np.int32, places), (np.int32, kinds))]
        values = pa.StructArray.from_arrays([pa.array(flat[0].view(np.int64)), *map(pa.array, flat[1:])], ["hash", "at", "length"])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return F.arrow_udf(compute, T.ArrayType(kind))(F.col(text).cast("binary"))


def n_words(text: str) -> Column:
    """Words of a text; null has none."""

    def compute(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, np.int64), *[np.diff(batch.Words(o, e, WORD).first) for o, e in batch.slices(texts)]]))

    return F.arrow_udf(compute, T.LongType())(F.col(text).cast("binary"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, length, words): every window of an item, or the whole of a shorter one."""
    kind = T.ArrayType(T.StructType([T.StructField("length", T.IntegerType()), T.StructField("words", T.StringType())]))

    def compute(texts: pa.Array) -> pa.Array:
        out = []
        for data in texts.to_pylist():
            words = words_of(data or b"")
            n = min(window, len(words))
            runs = {b" ".join(words[i : i + n]).decode() for i in range(len(words) - n + 1)} if n else ()
            out.append([{"length": n, "words": r} for r in sorted(runs)])
        return pa.array(out, pa.list_(pa.struct([("length", pa.int32()), ("words", pa.string())])))

    windows = F.arrow_udf(compute, kind)(F.col("text").cast("binary"))
    return benchmark.select("item_id", F.inline(windows)).distinct()


def _candidates(text: str, seeds: str, window: int, gram: int) -> Column:
    """The windows of a text that contain one of its seeds: array of (start, length, words)."""
    kind = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("words", T.StringType())])

    def compute(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for data, hits in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            words = words_of(data or b"")
            spans = set()
            for hit in hits:
                at, n = hit["at"], hit["length"]
                first = at - (n - gram) if n == window else at
                spans.update((s, n) for s in range(max(first, 0), min(at, len(words) - n) + 1))
            out.append([{"start": s, "length": n, "words": b" ".join(words[s : s + n]).decode()} for s, n in sorted(spans)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("words", pa.string())])))

    return F.arrow_udf(compute, T.ArrayType(kind))(F.col(text).cast("binary"), F.col(seeds))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM):
    """The benchmark's windows (item_id, length, words), and distinct (row_key, start, length, words): where windows of the benchmark occur in docs (row_key, text).

    The kept hashes only nominate positions; each nominated window is looked up by its words.
    """
    items = store.materialize(benchmark.select("item_id", "text"), "items")
    windows = store.materialize(item_windows(items, window), "windows")
    known = windows.select("length", "words").distinct()
    lengths = sorted(r[0] for r in known.select("length").distinct().collect() if r[0] < window)
    kept = items.select(F.inline(fingerprints("text", lengths, window, gram))).select("hash").distinct()
    kept = store.small(store.materialize(kept, "kept"))
    nominated = docs.select("row_key", F.inline(fingerprints("text", lengths, window, gram))).join(kept, "hash", "left_semi")
    seeds = store.materialize(
        nominated.groupBy("row_key").agg(F.collect_set(F.struct("at", "length")).alias("seeds")), "seeds"
    )
    candidates = docs.join(store.small(seeds, 64 * F.size("seeds")), "row_key").select(
        "row_key", F.inline(_candidates("text", "seeds", window, gram))
    )
    known = store.small(store.materialize(known, "known"), F.octet_length("words"))
    return windows, candidates.join(known, ["length", "words"], "left_semi").distinct()


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (array of struct(start, length))."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, row (all its columns as a struct), n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; null benchmark texts have no windows; an empty
    benchmark hits nothing; an empty table of documents gives no rows. Equal rows get equal answers.
    Very long texts are looked at whole. Other columns of docs, of any name, are in ``row`` only.
    """
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "text", store.row_key("doc_id", "text").alias("row_key"))
    windows, found = hits(keyed.select("row_key", "text"), benchmark)
    found = store.materialize(found, "hits")
    covered = found.groupBy("row_key").agg(F.collect_set(F.struct("start", "length")).alias("_s")).select(
        "row_key", _covered(F.col("_s")).cast("long").alias("n_hit")
    )
    pairs = found.select("row_key", "length", "words").distinct().join(windows, ["length", "words"])
    items = pairs.groupBy("row_key").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items")
    )
    per_row = store.materialize(covered.join(items, "row_key"), "contaminated")
    none = F.array().cast("array<string>")
    ids = F.coalesce("_items", none)
    return keyed.join(store.small(per_row, 32 * F.size("_items")), "row_key", "left").select(
        "doc_id",
        "row",
        n_words("text").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")


ORACLE = r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT runs.doc_id, runs.n, runs.i, win.item_id FROM runs JOIN win USING (n, g)),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
