"""Writers of ranked results and training pairs. Each is a table of lines first, so it can be checked, then a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loresift.functions.ordinals import with_ordinal
from loresift.functions.storage import stored
from loresift.functions.text import passage_parts


def limited(hits: DataFrame, most: int = 100, delimiter: str | None = None, max_passage: bool = False) -> DataFrame:
    """hits (query, docid, rank, score, ...) cut to ``most`` a query and ranked anew.

    With max_passage only the best hit of each page counts, the page being the docid up to the delimiter.
    """
    out = hits
    if max_passage:
        page = F.substring_index(F.col("docid").cast("string"), delimiter or "#", 1)
        first = W.partitionBy("query", "_page").orderBy("rank")
        out = out.withColumn("_page", page).withColumn("_f", F.row_number().over(first)).where("_f = 1").withColumn("docid", F.col("_page"))
        again = W.partitionBy("query").orderBy("rank")
        out = out.withColumn("rank", F.row_number().over(again)).drop("_page", "_f")
    return out.where(F.col("rank") <= most)


def trec_lines(hits: DataFrame, tag: str = "loresift") -> DataFrame:
    line = F.format_string("%s Q0 %s %d %.6f %s", F.col("query").cast("string"), F.col("docid").cast("string"), F.col("rank"), F.col("score"), F.lit(tag))
    return hits.select("query", "rank", line.alias("line"))


def msmarco_lines(hits: DataFrame) -> DataFrame:
    return hits.select("query", "rank", F.concat_ws("\t", F.col("query").cast("string"), F.col("docid").cast("string"), F.col("rank").cast("string")).alias("line"))


def _ranked(record: Column) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct("rank", record.alias("r"))))
    return F.transform(ordered, lambda x: x["r"])


def kilt_lines(hits: DataFrame, topics: DataFrame) -> DataFrame:
    """One JSON object a topic: id, input, output with one entry holding the provenance of its hits in rank order.

    hits: (query, docid, rank, score, title, text) and, if wanted, keys as JSON text.
    """
    parts = passage_parts(F.col("docid").cast("string"))
    fields = [
        parts["page"].try_cast("long").alias("wikipedia_id"),
        F.coalesce(parts["start"], F.lit(0)).alias("start_paragraph_id"),
        F.coalesce(parts["end"], F.lit(0)).alias("end_paragraph_id"),
        F.concat_ws(" @@ ", "title", "text").alias("text"),
        F.round("score", 6).alias("score"),
    ]
    if "keys" in hits.columns:
        fields.append(F.struct(F.col("keys")).alias("meta"))
    grouped = hits.groupBy("query").agg(_ranked(F.struct(*fields)).alias("provenance"))
    found = topics.join(grouped, "query", "left")
    empty = F.array().cast(grouped.schema["provenance"].dataType)
    record = F.struct(F.col("query").cast("string").alias("id"), F.col("input"), F.array(F.struct(F.coalesce("provenance", empty).alias("provenance"))).alias("output"))
    return found.select("query", F.to_json(record).alias("line"))


def dpr_lines(hits: DataFrame, topics: DataFrame) -> DataFrame:
    """One JSON object a topic: the topic's whole record and the contexts found, in rank order; topics without hits have none.

    topics: (query, ...): every other column is a field of the record; ``input`` is its question,
    and fields that a column ``record`` holds as JSON text come first.
    """
    context = F.struct(F.trim("title").alias("title"), F.trim("text").alias("text"), F.round("score", 6).alias("score"), F.col("docid").cast("string").alias("passage_id"))
    grouped = hits.groupBy("query").agg(_ranked(context).alias("ctxs"))
    found = topics.join(grouped, "query", "left")
    empty = F.array().cast(grouped.schema["ctxs"].dataType)
    ctxs = F.coalesce("ctxs", empty).alias("ctxs")
    if "record" in topics.columns:
        whole = F.concat(F.expr("substring(record, 1, length(record) - 1)"), F.lit(", "), F.substr(F.to_json(F.struct(ctxs)), F.lit(2)))
        return found.select("query", whole.alias("line"))
    fields = [F.col(c).alias("question" if c == "input" else c) for c in topics.columns if c != "query"]
    return found.select("query", F.to_json(F.struct(*fields, ctxs)).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text, queries and ranks in order over the part files."""
    order = [c for c in ("query", "rank") if c in lines.columns]
    (lines.orderBy(*order) if order else lines).select("line").write.mode("overwrite").text(path)


def write_array(lines: DataFrame, path: str) -> None:
    """JSON objects (query, line) as one JSON array over the part files: brackets at the first and the last, commas between."""
    ends = lines.agg(F.min("query").alias("_first"), F.max("query").alias("_last"))
    rows = lines.join(F.broadcast(ends))
    before = F.when(F.col("query") == F.col("_first"), F.lit("[")).otherwise(F.lit(", "))
    after = F.when(F.col("query") == F.col("_last"), F.lit("]")).otherwise(F.lit(""))
    write_lines(rows.select("query", F.concat(before, "line", after).alias("line")), path)


def write_pairs(pairs: DataFrame, path: str, append: bool = False, text: bool = False) -> None:
    """Sources and targets with the leading space that word-piece tokenizers want: one table, or line by line in path.source and path.target."""
    spaced = pairs.select(*[F.concat(F.lit(" "), F.trim(c)).alias(c) for c in ("source", "target")])
    mode = "append" if append else "overwrite"
    if not text:
        spaced.write.mode(mode).parquet(path)
        return
    # numbered once: both files have the same order
    numbered = stored(with_ordinal(stored(spaced.withColumn("_at", F.monotonically_increasing_id()), "pairs"), "_at", "line"), "lines")
    for side in ("source", "target"):
        numbered.orderBy("line").select(side).write.mode(mode).text(f"{path}.{side}")


def write_binarised(lines: DataFrame, path: str) -> None:
    """Token ids (split, source, target: space-joined ids) as a table of integer arrays, partitioned by split and side."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.split(s, " ").cast("array<int>").alias("ids")) for s in ("source", "target")])
    lines.select("split", F.inline(sides)).write.mode("overwrite").partitionBy("split", "side").parquet(path)


def trec(hits: DataFrame, topics: DataFrame, path: str, tag: str = "loresift") -> None:
    write_lines(trec_lines(hits, tag), path)


def msmarco(hits: DataFrame, topics: DataFrame, path: str, tag: str = "loresift") -> None:
    write_lines(msmarco_lines(hits), path)


def kilt(hits: DataFrame, topics: DataFrame, path: str, tag: str = "loresift") -> None:
    write_lines(kilt_lines(hits, topics), path)


def dpr(hits: DataFrame, topics: DataFrame, path: str, tag: str = "loresift") -> None:
    write_array(dpr_lines(hits, topics), path)


WRITERS = {"trec": trec, "msmarco": msmarco, "kilt": kilt, "dpr": dpr}


def write(hits: DataFrame, topics: DataFrame, path: str, kind: str, tag: str = "loresift") -> None:
    if kind not in WRITERS:
        raise ValueError(f"unknown output format {kind}; there are {', '.join(WRITERS)}")
    WRITERS[kind](hits, topics, path, tag)
