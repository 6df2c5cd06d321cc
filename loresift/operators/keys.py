"""Keys of queries: spans, their scores under a model, duplicates, and what the corpus says of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loresift.functions import scoring
from loresift.functions.text import spans, variants


def query_keys(queries: DataFrame, longest: int = 3, capitals: bool = False) -> DataFrame:
    """Distinct (query, ngram, n): spans of up to ``longest`` words, as they are or with every choice of capitals."""
    found = queries.select("query", F.explode(spans("toks", longest)).alias("ngram"))
    if capitals:
        found = found.distinct().select("query", F.explode(variants("ngram")).alias("ngram"))
    return found.distinct().withColumn("n", F.size(F.split("ngram", " ")))


def occurring(keys: DataFrame, counts: DataFrame) -> DataFrame:
    return keys.join(counts, "ngram", "left_semi")


def absent(keys: DataFrame, counts: DataFrame) -> DataFrame:
    return keys.join(counts, "ngram", "left_anti")


def first_of_each(keys: DataFrame, order: list) -> DataFrame:
    """One row per (query, ngram): the first in the order given."""
    at = W.partitionBy("query", "ngram").orderBy(*order)
    return keys.withColumn("_r", F.row_number().over(at)).where("_r = 1").drop("_r")


@dataclass
class CountScorer:
    """A model without weights: p(token | query) = (tf in query + mu cf / N) / (query length + mu).

    Stands where a language model would; any object with these two methods can take its place.
    queries have ``toks`` and, from a searcher, ``prompt``, the text that a model would be asked.
    Tokens of ``banned`` have no probability. A temperature other than 1 divides the logarithms of
    unigrams; what is left of a query's probability is shared by all its tokens alike.
    """

    mu: float = 10.0
    temperature: float = 1.0
    banned: tuple[str, ...] = ()

    def _tokens(self, queries: DataFrame, token_counts: DataFrame, total) -> DataFrame:
        """(query, token, lp) for tokens of the queries that the corpus holds."""
        tf = queries.select("query", F.size("toks").alias("len"), F.explode("toks").alias("token")).groupBy("query", "len", "token").agg(F.count("*").alias("tf"))
        p = (F.col("tf") + F.lit(self.mu) * F.col("cf") / total) / (F.col("len") + self.mu)
        known = tf.join(token_counts, "token")
        if self.banned:
            known = known.where(~F.col("token").isin(*self.banned))
        return known.select("query", "token", "cf", F.round(F.log(p), 9).alias("lp"))

    def unigrams(self, queries: DataFrame, token_counts: DataFrame, total) -> DataFrame:
        found = self._tokens(queries, token_counts, total)
        if self.temperature == 1.0:
            return found
        # log of p ** (1 / t) over its sum; of the corpus's other tokens the sum is sum(cf ** (1 / t)) times a factor of the query
        t = self.temperature
        allowed = token_counts.where(~F.col("token").isin(*self.banned)) if self.banned else token_counts
        every = allowed.agg(F.sum(F.pow("cf", F.lit(1 / t))).alias("_all"))
        per_query = (
            found.groupBy("query").agg(F.sum(F.exp(F.col("lp") / t)).alias("_own"), F.sum(F.pow("cf", F.lit(1 / t))).alias("_cf"))
            .join(queries.select("query", F.size("toks").alias("len")), "query")
            .join(F.broadcast(every))
        )
        share = F.pow(F.lit(self.mu) / total / (F.col("len") + self.mu), F.lit(1 / t))
        z = per_query.select("query", F.log(F.col("_own") + share * (F.col("_all") - F.col("_cf"))).alias("_z"))
        return found.join(z, "query").select("query", "token", "cf", F.round(F.col("lp") / t - F.col("_z"), 9).alias("lp"))

    def keys(self, queries: DataFrame, keys: DataFrame, token_counts: DataFrame, total) -> DataFrame:
        """keys (query, ngram, n) with lp, the sum of their tokens' log probabilities. Tokens may be foreign to the query."""
        lengths = queries.select("query", F.size("toks").alias("len"))
        known = self._tokens(queries, token_counts, total).select("query", "token", "lp")
        pieces = keys.select("query", "ngram", "n", F.explode(F.split("ngram", " ")).alias("token"))
        background = F.log(F.lit(self.mu) * F.col("cf") / total / (F.col("len") + self.mu))
        return (
            pieces.join(known, ["query", "token"], "left")
            .join(token_counts, "token", "left")
            .join(lengths, "query")
            .withColumn("one", F.coalesce("lp", background))
            .groupBy("query", "ngram", "n")
            .agg(F.round(F.sum("one"), 9).alias("lp"), F.count(F.when(F.col("one").isNull(), 1)).alias("_unknown"))
            .where("_unknown = 0")
            .drop("_unknown")
        )


def score_keys(keys: DataFrame, counts: DataFrame, total, options) -> DataFrame:
    """keys (query, ngram, n, lp) with count and score; keys that do not occur go."""
    scored = keys.join(counts, "ngram")
    if options.use_index_frequency:
        score = scoring.key_score("lp", "count", "n", total, options.smoothing, options.score_exponent, options.length_penalty)
    else:
        least = F.min("lp").over(W.partitionBy("query"))
        score = scoring.cutoff_score("lp", least, "n", options.score_exponent, options.length_penalty)
    return scored.withColumn("score", F.round(score, options.digits))


def score_unigrams(unigrams: DataFrame, keys: DataFrame, total, options) -> DataFrame:
    """(query, token, score): the top_k_unigrams likeliest tokens; those that are keys themselves and worthless ones go.

    Without corpus frequencies: how far the log probability is above the least of the query's keys, less 0.1, to the power.
    """
    best = W.partitionBy("query").orderBy(F.desc("lp"), "token")
    top = unigrams.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= options.top_k_unigrams)
    single = keys.where("n = 1").select("query", F.col("ngram").alias("token"))
    rest = top.join(single, ["query", "token"], "left_anti")
    if options.use_index_frequency:
        score = scoring.unigram_score("lp", "cf", total, options.smoothing)
    else:
        rest = rest.join(keys.groupBy("query").agg(F.min("lp").alias("_least")), "query")
        score = scoring.cutoff_score("lp", F.col("_least"), F.lit(1), options.score_exponent)
    scored = rest.withColumn("score", F.round(score, options.digits))
    return scored.where("score > 0").select("query", "token", "cf", "score")


def add_best_unigrams(keys: DataFrame, unigrams: DataFrame) -> DataFrame:
    """Append to each query as many of its best unigrams as it has keys."""
    have = keys.groupBy("query").agg(F.count("*").alias("have"))
    best = W.partitionBy("query").orderBy(F.desc("score"), "token")
    added = (
        unigrams.withColumn("_r", F.row_number().over(best))
        .join(have, "query")
        .where("_r <= have")
        .select("query", F.col("token").alias("ngram"), F.lit(1).alias("n"), F.col("cf").alias("count"), "score")
    )
    return keys.select("query", "ngram", "n", "count", "score").unionByName(added)


def split_by_frequency(keys: DataFrame, options) -> DataFrame:
    """Keys with kind ``rare`` or ``freq``; keys that are too frequent altogether or worthless go."""
    kept = keys.where((F.col("count") <= options.max_occurrences_2) & (F.col("score") != 0))
    frequent = (F.col("count") > options.max_occurrences_1) | (F.col("score") < 0)
    return kept.withColumn("kind", F.when(frequent, "freq").otherwise("rare"))
