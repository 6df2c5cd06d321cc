"""Readers of corpora, topics and training data. Each returns a DataFrame with a fixed schema."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresift.functions.ordinals import with_ordinal


def _tab_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines with exactly as many tab-separated fields as names; others are malformed and go."""
    parts = F.split(F.trim("value"), "\t", len(names))
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == len(names))
    return rows.select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) from lines id, title, text."""
    return _tab_rows(spark, path, ["id", "title", "text"])


def passages_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) from a quoted table with a header: id, text, title."""
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, mode="DROPMALFORMED", schema="id string, text string, title string")
    return rows.where("id is not null and text is not null and title is not null").select("id", "title", "text")


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """(key, title, text) for lookups; rows with an empty field go."""
    rows = _tab_rows(spark, path, ["key", "title", "text"])
    return rows.where("length(trim(key)) > 0 and length(trim(title)) > 0 and length(trim(text)) > 0")


def codes(spark: SparkSession, path: str) -> DataFrame:
    """(key, code); blank lines go."""
    return _tab_rows(spark, path, ["key", "code"])


def _ordered(df: DataFrame) -> DataFrame:
    return with_ordinal(df.withColumn("_at", F.monotonically_increasing_id()), "_at", "topic").drop("_at")


def topics_questions(spark: SparkSession, path: str) -> DataFrame:
    """(topic, query, record) from a JSON array of objects with a question; topics are ordinals."""
    rows = spark.read.json(path, multiLine=True)
    return _ordered(rows.select(F.col("question").alias("query"), F.to_json(F.struct("*")).alias("record")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal(values: pd.Series) -> pd.Series:
    def one(v):
        got = ast.literal_eval(v)
        if not isinstance(got, list) or not all(isinstance(x, str) for x in got):
            raise ValueError(f"not a list of strings: {v[:100]}")
        return got

    return values.map(one)


def topics_answers(spark: SparkSession, path: str) -> DataFrame:
    """(topic, query, answers) from lines question, list of answers; topics are ordinals."""
    return _ordered(_tab_rows(spark, path, ["query", "list"]).select("query", _literal("list").alias("answers")))


def topics_natural(spark: SparkSession, path: str) -> DataFrame:
    """(topic, query) from JSON lines with example_id and question_text."""
    return spark.read.json(path).select(F.col("example_id").cast("string").alias("topic"), F.col("question_text").alias("query"))


def topics_input(spark: SparkSession, path: str) -> DataFrame:
    """(topic, query) from JSON lines with id and input."""
    return spark.read.json(path).select(F.col("id").cast("string").alias("topic"), F.col("input").alias("query"))


def topics_template(spark: SparkSession, path: str) -> DataFrame:
    """(topic, query) from JSON lines with id and meta.template_questions, of which the first is asked."""
    return spark.read.json(path).select(F.col("id").cast("string").alias("topic"), F.col("meta.template_questions")[0].alias("query"))


def topics_default(spark: SparkSession, path: str) -> DataFrame:
    """(topic, query) from lines topic, query."""
    return _tab_rows(spark, path, ["topic", "query"])


TOPICS = {
    "default": topics_default,
    "kilt": topics_input,
    "kilt_template": topics_template,
    "dpr": topics_questions,
    "dpr_qas": topics_answers,
    "nq": topics_natural,
}


def topics(spark: SparkSession, path: str, kind: str, debug: bool = False, keep_samples: int | None = None) -> DataFrame:
    """Topics of a format; debug takes the first 500, keep_samples that many by a fixed shuffle."""
    if kind not in TOPICS:
        raise ValueError(f"unknown topic format {kind}; there are {', '.join(TOPICS)}")
    out = TOPICS[kind](spark, path)
    if debug:
        out = out.orderBy("topic").limit(500)
    if keep_samples is not None:
        out = out.orderBy(F.md5(F.concat(F.lit("42|"), F.col("topic").cast("string"))), "topic").limit(keep_samples)
    return out


def positive_contexts(spark: SparkSession, path: str) -> DataFrame:
    """(sample, question, rank, title, text, score, title_score, key) from a JSON array with positive_ctxs."""
    rows = _ordered(spark.read.json(path, multiLine=True)).withColumnRenamed("topic", "sample")
    exploded = rows.select("sample", "question", F.posexplode("positive_ctxs").alias("place", "c"))
    return exploded.select(
        "sample", "question", (F.col("place") + 1).alias("rank"), "c.title", "c.text", "c.score", "c.title_score", F.col("c.passage_id").alias("key")
    )


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(sample, question, place, key) from JSON lines with input and output[].provenance[]; outputs without one go."""
    rows = _ordered(spark.read.json(path)).withColumnRenamed("topic", "sample")
    outs = rows.select("sample", "input", F.posexplode("output").alias("o", "out"))
    found = outs.where("out.provenance is not null").select("sample", "input", "o", F.posexplode("out.provenance").alias("p", "prov"))
    question = F.trim(F.regexp_replace(F.regexp_replace(F.trim("input"), "\n", " / "), r"\s+", " "))
    key = F.concat_ws("-", F.col("prov.wikipedia_id").cast("string"), F.col("prov.start_paragraph_id").cast("string"))
    return found.select("sample", question.alias("question"), (F.col("o") * 1_000_000 + F.col("p")).alias("place"), key.alias("key"))


def parallel_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(line, source, target): two files of as many lines, line by line; blank on either side drops both."""

    def numbered(path: str, name: str) -> DataFrame:
        lines = spark.read.text(path).withColumnRenamed("value", name)
        return with_ordinal(lines.withColumn("_at", F.monotonically_increasing_id()), "_at", "line").drop("_at")

    both = numbered(left, "source").join(numbered(right, "target"), "line")
    return both.where("length(trim(source)) > 0 and length(trim(target)) > 0")
