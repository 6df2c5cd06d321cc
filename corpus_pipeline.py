"""From documents to token ids: five stages, each on all that the one before kept.

All stages but the last return the columns of docs, whatever others there are beside those that
they read. Empty tables give empty tables; very long texts are used whole. Each stage's table is
stored, and deleted once the next stage's is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loresift.llm import decontaminate, mixing, quality, simhash, store, token_output


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null texts count as empty; repeated rows fare alike; without labels none is accepted."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id from each group of near-duplicates.

    Of repeated rows one stays. Empty and null texts are one group. A row without an id stays only
    where its whole group has none, one for each fingerprint.
    """
    return simhash.kept(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item. Null and empty texts have none and stay; repeated rows fare alike; an empty benchmark takes nothing."""
    found = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("not contaminated").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for; one a source is cut at its budget's end.

    A null source is one of its own. Null and empty texts have no words: they stay once for each
    whole pass over their source. Equal rows are interchangeable.
    """
    return mixing.mixed_documents(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A token folder, and what reading it back gives per row: doc_id, start, n_tokens, ids_crc32. Null texts count as empty; null ids come first."""
    import public_tokenizers

    return token_output.digest(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources", mix_sources),
    ("token ids", to_token_ids),
]

#: Fingerprints, classifier scores and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = store.materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
        if before is not None:
            store.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
