"""SimHash near-duplicates by pivot distance tables.

A fingerprint's distances to fixed reference fingerprints (pivots) are its row of the pivot
table. By the triangle inequality two fingerprints within r bits differ by at most r in every
coordinate; pairs that differ by more in any are discarded, and survivors are compared bit by bit.

Which pairs to look up in the tables: with r + e blocks of bits, two fingerprints within r bits
agree on e whole blocks at least, so the pairs that agree on some e blocks are all that matter.
Each choice of e blocks is a key; pairs are formed within a key only, never all against all.
Only distinct fingerprints take part: copies join through their fingerprint.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresift.llm import store
from loresift.llm.components import components
from loresift.llm.groups import groups

SHINGLE = 4
RADIUS = 4
SEED = 42
PIVOTS = 16
#: Fingerprints of one key that are compared in one piece; a larger key is dealt in pairs of such chunks.
CHUNK = 2048
#: Groups up to this size are compared in full, many at a time.
SMALL_GROUP = 24
#: Pairs whose table rows are held at once.
PAIRS = 1 << 18

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(data: bytes) -> int:
    """64 bits from a text in UTF-8: bit b is 1 if set in over half the hashes of its word shingles.

    A-Z are lower-cased. A text with fewer words than a shingle is one shingle; without words the result is 0.
    """
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    n = max(len(words) - SHINGLE + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[i:j], SEED) for i, j in zip(starts, stops, strict=True)), np.uint64, n)
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(text: str | Column) -> Column:
    """Fingerprints as signed 64-bit integers; null counts as empty."""

    def compute(texts: pa.Array) -> pa.Array:
        got = np.array([fingerprint(t or b"") for t in texts.to_pylist()], np.uint64)
        return pa.array(got.view(np.int64))

    column = F.col(text) if isinstance(text, str) else text
    return F.arrow_udf(compute, T.LongType())(column.cast("binary"))


def _pivots() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def pivot_row(fp: str) -> list[Column]:
    """A fingerprint's row of the pivot table: its Hamming distances to the pivots, eight bytes to a long."""
    far = [F.bit_count(F.col(fp).bitwiseXOR(F.lit(p))).cast("long") for p in _pivots().view(np.int64).tolist()]
    return [
        reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(d, 8 * k) for k, d in enumerate(far[at : at + 8])]).alias(f"pivots{at // 8}")
        for at in range(0, PIVOTS, 8)
    ]


PIVOT_COLUMNS = [f"pivots{k}" for k in range(PIVOTS // 8)]


def _table(rows: pa.Table) -> np.ndarray:
    """The pivot table of rows that carry theirs."""
    longs = np.stack([rows[c].to_numpy() for c in PIVOT_COLUMNS], axis=1)
    return np.ascontiguousarray(longs, "<i8").view(np.int8)


def _near(values: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (i, j) are within radius: by the tables, coordinate after coordinate, then exactly."""
    left = np.arange(len(i))
    for k in range(table.shape[1]):
        column = table[:, k]
        left = left[np.abs(column[i[left]] - column[j[left]]) <= radius]
        if not len(left):
            return left
    return left[np.bitwise_count(values[i[left]] ^ values[j[left]]) <= radius]


def _forest(values: np.ndarray, table: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join whatever the near pairs of one group join: one at most per member.

    side: -1 if the group is one chunk; else 0 or 1, and pairs across sides are looked at (those
    within a side are another group's). Every pair is compared unless links join it already, so
    a dense group costs little more than one pass over it.
    """
    members = np.arange(len(values))
    ones, others = (members[side == 0], members[side == 1]) if side[0] >= 0 else (members, members)
    if not len(ones) or not len(others):
        return []
    links: list[tuple[int, int]] = []
    label, parent = members, members.tolist()
    most = max(1, PAIRS // len(others))
    at, step = 0, min(8, most)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    while at < len(ones) and label.any():
        some = ones[at : at + step]
        rest = others if side[0] >= 0 else others[at:]
        i, j = np.nonzero(label[some][:, None] != label[rest])
        i, j = some[i], rest[j]
        left = _near(values, table, i, j, radius)
        i, j = i[left], j[left]
        for k in np.unique(label[i] * len(values) + label[j], return_index=True)[1].tolist():
            a, b = sorted((root(int(i[k])), root(int(j[k]))))
            if a != b:
                parent[b] = a
                links.append((int(i[k]), int(j[k])))
        at, step = at + step, min(2 * step, most)
        label = np.array(parent)
        while (label[label] != label).any():
            label = label[label]
    return links


def _blocks(n: int, radius: int) -> tuple[int, int]:
    """Blocks of bits and how many of them must agree: enough that a key has few members among n at random."""
    for agree in (1, 2, 3, 4, 5):
        blocks = radius + agree
        if n >> (64 // blocks * agree) <= 2 or agree == 5:
            return blocks, agree
    raise AssertionError


def keys(value: str, n: int, radius: int = RADIUS) -> Column:
    """Array of keys, one for each choice of blocks: the value's bits in them, with the choice's number hashed in."""
    blocks, agree = _blocks(n, radius)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in choice) for choice in combinations(range(blocks), agree)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(k), F.col(value).bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of representatives whose fingerprints are near; what all near pairs join, these join.

    distinct: rep (long), fp (long, distinct). A key with more than CHUNK members is dealt by
    hash into chunks, and each pair of chunks is a group of its own, so no task holds a large key.
    Keys are many times the rows they are made from, which Spark's estimate of their size leaves
    out: the joins are told to shuffle, or the driver would be sent every key.
    """
    n = distinct.count()
    table = distinct.select("rep", "fp", *pivot_row("fp"))
    keyed = table.select("rep", "fp", *PIVOT_COLUMNS, F.explode(keys("fp", n, radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    dealt = keyed.join(sizes.hint("merge"), "key").withColumn("chunks", chunks).withColumn(
        "mine", F.pmod(F.xxhash64("fp", F.lit(1)), "chunks").cast("int")
    )
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key",
        F.least("mine", "other").alias("low"),
        F.greatest("mine", "other").alias("high"),
        F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        "rep",
        "fp",
        *PIVOT_COLUMNS,
    )

    def compare(batches):
        for table, cuts in groups(batches, ("key", "low", "high")):
            reps, values = table["rep"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
            side = table["side"].to_numpy()
            first, size = cuts[:-1], np.diff(cuts)
            table_rows, found = _table(table), []
            for m in np.unique(size[size <= SMALL_GROUP]).tolist():
                i, j = np.triu_indices(m, 1)
                at = first[size == m][:, None]
                i, j = (at + i).ravel(), (at + j).ravel()
                left = _near(values, table_rows, i, j, radius)
                found.append(np.stack([i[left], j[left]], axis=1))
            for at, m in zip(first[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist(), strict=True):
                # members of the group's one chunk are compared with each other; two chunks only across
                got = _forest(values[at : at + m], table_rows[at : at + m], side[at : at + m], radius)
                found.append(np.array(got, np.int64).reshape(-1, 2) + at)
            every = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.record_batch([pa.array(reps[every[:, 0]]), pa.array(reps[every[:, 1]])], ["a", "b"])

    order = ("key", "low", "high")
    return paired.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id, the least doc_id reachable over links.

    Empty and null texts have fingerprint 0 and link like any other. A null doc_id gets its
    fingerprint and its component, but names none; where no doc_id of a component is known the
    component is null. Repeated rows fall into one component. Very long texts are used whole, an
    empty table gives no rows, and other columns of docs, of any name, are not read.
    """
    prints = store.materialize(docs.select("doc_id", fingerprints("text").alias("fp")), "prints")
    return assign(prints, radius)


def _joined(distinct: DataFrame, radius: int) -> DataFrame:
    """The rows of distinct, a stored table with a row for each fp, and component_id, the least rep reachable."""
    merged = components(store.materialize(links(distinct, radius), "links"))
    joined = distinct.join(merged.hint("merge"), F.col("rep") == F.col("node"), "left").drop("node")
    return joined.withColumn("component_id", F.coalesce("component", "rep")).drop("component")


def assign(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Components for (doc_id, fp) rows of a stored table."""
    distinct = store.materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "distinct"
    )
    return prints.join(_joined(distinct, radius).select("fp", "component_id"), "fp", "left")


def hexadecimal(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def kept(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, that represent their component: one row for each.

    Of repeated rows one stays. Where a component has no doc_id at all, one row for each of its fingerprints stays.
    Texts are not moved: rows are numbered as they are stored, and which stay is told by a bitmap for each run of numbers.
    """
    numbered = docs.select(F.struct("*").alias("row"), "doc_id", fingerprints("text").alias("fp"), F.monotonically_increasing_id().alias("at"))
    rows = store.materialize(numbered, "rows")
    # of a fingerprint's rows only one can stay, the first of its least doc_id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at")).alias("first")
    firsts = store.materialize(rows.groupBy("fp").agg(first).select("fp", F.col("first.doc_id").alias("rep"), "first.at"), "distinct")
    named, unnamed = firsts.where("rep is not null"), firsts.where("rep is null")
    staying = _joined(named, radius).where("rep = component_id").select("at").union(unnamed.select("at"))
    run, place = F.bitmap_bucket_number("at"), F.bitmap_bit_position("at")
    bits = staying.select(run.alias("run"), place.alias("place")).repartition("run").groupBy("run").agg(F.bitmap_construct_agg("place").alias("bits"))
    bits = store.materialize(bits, "bits")
    octet = F.conv(F.hex(F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    stays = F.getbit(octet, place.bitwiseAND(F.lit(7))) == 1
    return rows.join(store.small(bits, F.length("bits")), run == F.col("run")).where(stays).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")
