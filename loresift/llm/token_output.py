"""Token ids in a binary format: frequency-ranked, byte-aligned variable length, control bytes apart.

Ids are renumbered by how often the corpus holds them, so the common ones fit one byte. Each
value takes 1 to 4 bytes; its length goes as 2 bits into a stream of control bytes, four values
a byte, apart from the stream of data bytes. Decoding looks the control bytes up in two numpy
tables (bytes taken, and where each value's bytes lie) and gathers whole documents at once.

A token folder holds ``streams`` (Parquet files, in the order of their shard numbers and rows:
shard, local_start, doc_id, n_tokens, control, data) and ``dictionary`` (rank, id). Spark's
committer writes both, so a lost executor leaves no half-written file behind.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresift.llm import store
from loresift.llm.batch import binaries, slices, spans
from loresift.llm.pieces import WordPieces

END_ID = 2
#: Bytes of text encoded at once: the more, the fewer pieces are looked up again.
TEXT_SLICE = 4 << 20

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_TAKES = _LENGTHS.sum(axis=1)
_STARTS = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
#: For each control byte, the place of each of 16 output bytes among its data bytes; -1: zero.
_PLACES = np.where(
    np.arange(4)[None, None, :] < _LENGTHS[:, :, None], _STARTS[:, :, None] + np.arange(4)[None, None, :], -1
).reshape(256, 16)


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Control and data bytes, each with the rows' lengths, of rows of unsigned 32-bit values; a row starts a control byte."""
    v = np.ascontiguousarray(values, dtype="<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    controls = -(-counts // 4)
    fours = np.zeros(4 * int(controls.sum()), np.uint8)
    fours[spans(4 * (np.cumsum(controls) - controls), counts)] = code
    control = fours[0::4] | fours[1::4] << 2 | fours[2::4] << 4 | fours[3::4] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    taken = np.concatenate([[0], np.cumsum(code + np.int64(1))])
    return (control, controls), (data, np.diff(taken[np.concatenate([[0], np.cumsum(counts)])]))


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of rows, by table lookup, from their control and data bytes and their numbers of values."""
    controls = -(-counts // 4)
    takes = _TAKES[control]
    takes[np.cumsum(controls)[counts > 0] - 1] -= (4 * controls - counts)[counts > 0]  # a row's unused codes take no bytes
    begins = np.cumsum(takes) - takes
    source = np.concatenate([data, np.zeros(16, np.uint8)])
    places = _PLACES[control]
    out = source[begins[:, None] + places]
    out[places < 0] = 0
    return out.reshape(-1).view("<u4")[spans(4 * (np.cumsum(controls) - controls), counts)]


STREAMS = "shard long, local_start long, doc_id long, n_tokens long, control binary, data binary"
_STREAMS = pa.schema(
    [(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (c.split() for c in STREAMS.split(", "))]
)


_encoders: dict[str, WordPieces] = {}


def encoder(path: str) -> WordPieces:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordPieces(path)
    return _encoders[path]


def token_ids(text: str, path: str) -> Column:
    """Binary of a text's ids and the end id, as little-endian unsigned 32-bit integers; null counts as empty.

    For tokenizers whose pieces never hold white space: there a text's ids are its words' ids in order.
    """

    def encode(texts: pa.Array) -> pa.Array:
        parts = []
        for octets, ends in slices(texts, TEXT_SLICE):
            ids, counts = encoder(path).ids(octets, ends)
            ids = np.insert(ids, np.cumsum(counts), END_ID).astype("<u4")
            parts.append((ids.view(np.uint8), 4 * (counts + 1)))
        return binaries(parts)

    return F.arrow_udf(encode, T.BinaryType())(F.col(text).cast("binary"))


def _counts(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for octets, _ in slices(batch.column(0)):
            found = np.bincount(octets.view("<u4"), minlength=len(total))
            found[: len(total)] += total
            total = found
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def write_tokens(docs: DataFrame, path: str, folder: str) -> None:
    """Encode the whole texts of docs (doc_id, text) and write a token folder in ascending doc_id order.

    Null ids come first. Rows of equal id are ordered by their ids' hash. An empty table writes an
    empty folder. Very long texts are encoded whole, each on its own. Other columns of docs are not read. The dictionary has a row for each id in use, so at most the vocabulary's size.
    """
    spark = docs.sparkSession
    encoded = store.materialize(docs.select("doc_id", token_ids("text", path).alias("ids")), "ids")
    used = encoded.select("ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.array([r[0] for r in used.orderBy(F.desc("n"), "id").select("id").collect()], np.int64)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
    rank[by_rank] = np.arange(len(by_rank))

    def packed(values: pa.Array) -> pa.Array:
        controls, data, n = [], [], []
        for octets, ends in slices(values):
            counts = np.diff(ends, prepend=0) // 4
            one, two = pack(rank[octets.view("<u4")], counts)
            controls.append(one)
            data.append(two)
            n.append(counts)
        counts = pa.array(np.concatenate([np.zeros(0, np.int64), *n]))
        return pa.StructArray.from_arrays([counts, binaries(controls), binaries(data)], ["n_tokens", "control", "data"])

    def placed(batches):
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            shards = pa.array(np.full(len(n), shard), pa.int64())
            arrays = [shards, pa.array(starts), *[batch.column(c) for c in _STREAMS.names[2:]]]
            yield pa.RecordBatch.from_arrays(arrays, schema=_STREAMS)

    # packed, then stored: the exchange samples its input first, and moves a third of the plain ids
    kind = "struct<n_tokens:bigint,control:binary,data:binary>"
    rows = encoded.select("doc_id", F.xxhash64("ids").alias("h"), F.arrow_udf(packed, kind)("ids").alias("p"))
    stored = store.materialize(rows.select("doc_id", "h", "p.*"), "packed")
    store.discard(encoded)
    ordered = stored.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    streams = ordered.select("doc_id", "n_tokens", "control", "data").mapInArrow(placed, STREAMS)
    streams.write.option("compression", "zstd").parquet(f"{folder}/streams")
    spark.createDataFrame(
        pa.table({"rank": pa.array(range(len(by_rank)), pa.int64()), "id": pa.array(by_rank, pa.int64())})
    ).write.parquet(f"{folder}/dictionary")
    store.discard(stored)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a token folder: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    streams = spark.read.schema(STREAMS).parquet(f"{folder}/streams")
    dictionary = spark.read.schema("rank long, id long").parquet(f"{folder}/dictionary")
    by_rank = np.array([r[0] for r in dictionary.orderBy("rank").select("id").collect()], "<u4")

    def decode(control: pa.Array, data: pa.Array, n: pa.Array) -> pa.Array:
        parts, at = [], 0
        counts = n.to_numpy(zero_copy_only=False)
        for octets, ends in slices(data):
            mine = slice(at, at + len(ends))
            (codes, _), *_ = slices(control[mine], 1 << 62)
            ids = by_rank[unpack(codes, octets, counts[mine])]
            parts.append((ids.view(np.uint8), 4 * counts[mine]))
            at += len(ends)
        return binaries(parts)

    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = streams.groupBy("shard").agg(F.sum("n_tokens").alias("_n")).select(
        "shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    return streams.join(offsets, "shard").select(
        "doc_id",
        (F.col("_offset") + F.col("local_start")).alias("start"),
        "n_tokens",
        F.arrow_udf(decode, T.BinaryType())("control", "data", "n_tokens").alias("ids"),
    )


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Write docs as a token folder, read it back, and return doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = f"{store.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    store.expect(spark, folder)
    write_tokens(docs, path, folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs, public_tokenizers.path("word_bpe_49k.json"))
