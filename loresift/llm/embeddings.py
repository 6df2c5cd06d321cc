"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosines, connected components.

Each table hashes a vector to the signs of its products with random hyperplanes; vectors that
share a table's bucket are compared by exact cosine in double precision, block against block.
The bits of a bucket follow from the number of vectors, so that a bucket has some CHUNK members,
and the number of tables from the bits, so that a pair at the threshold shares no bucket with a
probability of MISS at most. Only distinct vectors are hashed; copies are counted. What is moved
is each table's vectors once, as they are stored, and the signs of all tables as bits.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loresift.llm import store
from loresift.llm.components import components
from loresift.llm.groups import groups

THRESHOLD = 0.98
MISS = 1e-5
SEED = 11
#: Vectors of one bucket that are compared in one piece; a larger bucket is dealt in pairs of such chunks.
CHUNK = 1024


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a bucket and number of tables for n vectors."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(24, max(4, n.bit_length() - CHUNK.bit_length() + 1))
    return bits, math.ceil(math.log(MISS) / math.log1p(-(same**bits)))


@lru_cache(maxsize=8)
def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def valid(vector: str, label: str) -> Column:
    """Whether a vector can link: labelled, not null, not zero, every component a finite number."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def buckets(vector: str, bits: int, tables: int, kind: str) -> Column:
    """Struct of a vector's bucket in every table, all its signs as bits, and its components (kind <f4 or <f8)."""

    def compute(vectors: pa.Array) -> pa.Array:
        rows = [np.asarray(v, kind) for v in vectors.to_pylist()]
        signs = np.zeros((len(rows), tables * bits), bool)
        dims = np.array([len(r) for r in rows])
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            signs[at] = np.stack([rows[i] for i in at]).astype(np.float64) @ _planes(dim, bits, tables) > 0
        codes = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(_codes(signs, bits).ravel()))
        packed = [r.tobytes() for r in np.packbits(signs, axis=1)]
        return pa.StructArray.from_arrays(
            [codes, pa.array(packed, pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())], ["codes", "signs", "data"]
        )

    return F.arrow_udf(compute, "struct<codes:array<int>,signs:binary,data:binary>")(F.col(vector))


def _codes(signs: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each row in every table."""
    return (signs.reshape(len(signs), -1, bits) @ (1 << np.arange(bits))).astype(np.int32)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member reachable from each of n members over the pairs."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def linked(distinct: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """Rows (rep, n, root) from each bucket with a link: vectors linked to rep found first there, and a member it reaches.

    distinct: rep, label, embedding, copies. A bucket with more than CHUNK members is dealt by
    hash into chunks, and each pair of chunks is a group of its own.
    """
    bucket = ("label", "dim", "no", "code")
    order = (*bucket, "low", "high")
    kind = "<f4" if distinct.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    hashed = distinct.select("rep", "label", "copies", F.size("embedding").alias("dim"), buckets("embedding", bits, tables, kind).alias("b"))
    hashed = store.materialize(hashed.select("rep", "label", "copies", "dim", "b.*"), "hashed")
    many = hashed.select("label", "dim", F.posexplode("codes").alias("no", "code")).groupBy(*bucket).agg(F.count("*").alias("members"))
    many = many.where(F.col("members") > CHUNK).select(*bucket, F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks"))
    spread = hashed.select("rep", "label", "copies", "dim", "signs", "data", F.posexplode("codes").alias("no", "code"))
    chunks = F.coalesce("chunks", F.lit(1))
    dealt = spread.join(store.small(store.materialize(many, "many")), list(bucket), "left").withColumn("chunks", chunks)
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        *bucket,
        F.least("mine", "other").alias("low"),
        F.greatest("mine", "other").alias("high"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"),
        "rep", "copies", "signs", "data",
    )

    def compare(batches):
        for table, cuts in groups(batches, order):
            rep, copies, side = (table[c].to_numpy() for c in ("rep", "copies", "side"))
            low, high, no, dim = (table[c].to_numpy() for c in ("low", "high", "no", "dim"))
            data, signs = table["data"].to_pylist(), table["signs"].to_pylist()
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a == 1:
                    continue
                x = np.frombuffer(b"".join(data[a:b]), kind).reshape(b - a, dim[a]).astype(np.float64)
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                if low[a] == high[a]:
                    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                else:
                    one, two = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
                    i, j = np.nonzero(x[one] @ x[two].T >= threshold)
                    i, j = one[i], two[j]
                if not len(i):
                    continue
                used = np.unique(np.concatenate([i, j]))
                packed = np.frombuffer(b"".join(signs[a + k] for k in used.tolist()), np.uint8).reshape(len(used), -1)
                own = np.zeros((b - a, no[a]), np.int32)
                own[used] = _codes(np.unpackbits(packed, axis=1)[:, : tables * bits], bits)[:, : no[a]]
                first = ~(own[i] == own[j]).any(axis=1)  # no earlier table has found the pair
                n = np.zeros(b - a, np.int64)
                np.add.at(n, i[first], copies[a:b][j[first]])
                np.add.at(n, j[first], copies[a:b][i[first]])
                root = _roots(b - a, i, j)
                out.append(np.stack([rep[a:b][used], n[used], rep[a:b][root[used]]]))
            rows = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
            yield pa.record_batch([pa.array(r) for r in rows], ["rep", "n", "root"])

    return paired.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "rep long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link within equal labels and lengths only. Null, zero or non-finite vectors, those
    without a label and rows without a vec_id link with nothing: 0 links, their own component.
    Copies of a vector link with each other; repeated rows of one vec_id count as copies, and
    where one vec_id has several vectors, they share their links. An empty table gives no rows;
    vectors of any length, and other columns of any name, are taken as they are.
    """
    rows = vectors.select("vec_id", "label", "embedding", (valid("embedding", "label") & F.col("vec_id").isNotNull()).alias("ok"))
    able = rows.where("ok")
    distinct = store.materialize(
        able.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct"
    )
    bits, tables = plan(distinct.count(), threshold)
    found = store.materialize(linked(distinct, bits, tables, threshold), "linked")
    merged = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (
        distinct.join(found.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left")
        .join(merged.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linkable = able.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    others = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linkable.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links,
       CAST(least(vec_id, coalesce(c.b, vec_id)) AS BIGINT) AS component_id,
       vec_id <= coalesce(c.b, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
