"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a key from the MD5 of its id; documents are range-sorted by it within their
source; distributed prefix sums of the sizes say where each source's budget ends. A source
whose target exceeds its size is repeated in whole epochs and then cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loresift.llm.prefix import prefix_sums
from loresift.llm.store import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(source_sizes: DataFrame) -> DataFrame:
    """Add ``target`` to (source_key, source_size): weighted shares, capped, the excess shared again.

    Sharing the excess by weight until no source is above its cap ends at target =
    min(cap, weight x level) for one level. Sources sorted by cap/weight fill up in that
    order, so the level is the first quotient (budget left)/(weight left) that the next
    source's ratio admits. One row per source, so the windows without a partition are small.
    """
    everything = W.orderBy("source_key")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    position = F.row_number().over(everything)
    by_ratio = W.orderBy("ratio", "source_key")
    whole = W.partitionBy(F.lit(0))
    return (
        source_sizes.withColumn("weight", F.element_at(weights, (position - 1) % len(WEIGHTS) + 1))
        .withColumn("cap", F.col("source_size") * MOST_EPOCHS)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(whole) * F.lit(SHARE) - F.col("full")) / F.col("left"))
        .withColumn(
            "first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(whole)
        )
        .withColumn(
            "target",
            F.when(F.col("place") < F.col("first.place"), F.col("cap").cast("double")).otherwise(
                F.least(F.col("cap").cast("double"), F.col("weight") * F.col("first.level"))
            ),
        )
        .select("source_key", "source_size", "target")
    )


def mix(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """Return doc_id, row, size, source_size, target, epochs, part for every row of docs.

    ``row`` is the input row as a struct, so its other columns may have any names. ``epochs``
    whole passes take the document; of one more pass ``part`` of its words are taken: all, none,
    or for the document that a source's budget ends in, the words up to the exact end.
    Empty or null texts have size 0 and take 0 words. A null source is a source of its own,
    sorted last. Null ids sort by an empty id. Equal rows are interchangeable. Two runs agree. Very
    long texts count whole; an empty table gives no rows. One task shares out the targets: it holds
    a row of a few numbers for each source, so some millions of sources at most.
    """
    sized = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("source_key"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
        (n_words("text") if size is None else size).alias("size"),
    )
    rows, ranges = prefix_sums(materialize(sized, "sized"), "source_key", ["key", "size"], "size")
    plan = targets(ranges.groupBy("source_key").agg(F.sum("total").alias("source_size")))
    take = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(take / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = take - F.col("epochs") * F.col("source_size") - F.col("before")
    return (
        rows.join(plan, "source_key")
        .withColumn("epochs", epochs)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest)))
        .select("doc_id", "row", "size", "source_size", "target", "epochs", "part")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of docs: one row per document and pass.

    A document cut by its source's budget keeps its first words, joined by single spaces.
    """
    passes = (
        mix(docs)
        .withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
        .where((F.col("_pass") < F.col("epochs")) | (F.col("part") > 0))
    )
    text = F.col("row.text")
    cut = (F.col("_pass") == F.col("epochs")) & (F.col("part") < F.col("size"))
    first = F.array_join(F.slice(F.split(F.regexp_replace(text, f"^{SPACE}", ""), SPACE), 1, F.col("part").cast("int")), " ")
    return passes.select(
        *[
            (F.when(cut, first).otherwise(text) if c == "text" else F.col("row").getField(c)).alias(c)
            for c in docs.columns
        ]
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    sized = docs.select("doc_id", "source", n_words("text").alias("_size"))
    return mix(sized, size=F.col("_size")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s),
f AS (
  SELECT *, cap / weight AS ratio,
         row_number() OVER o AS place,
         coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         sum(source_size) OVER () AS everything
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT *, (CAST(everything AS DOUBLE) * 1.5::DOUBLE - CAST(filled AS DOUBLE)) / CAST(weight_left AS DOUBLE) AS level FROM f),
first AS (SELECT place AS first_place, level AS first_level FROM l WHERE level <= ratio ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN place < first_place THEN CAST(cap AS DOUBLE)
              ELSE least(CAST(cap AS DOUBLE), weight * first_level) END AS target
  FROM l, first),
p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5::DOUBLE) AS BIGINT) AS take,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, take - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
