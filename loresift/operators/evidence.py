"""Documents scored by the evidence of the keys they hold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loresift.functions.storage import stored
from loresift.operators import match


def key_order(options) -> list:
    """Order in which keys are credited and the greatest key is chosen; every tie is settled by the key itself."""
    first = []
    if options.sort_by_length:
        first.append(F.desc("n"))
    if options.sort_by_freq:
        first.append(F.asc("count"))
    return [*first, F.desc("score"), F.asc("ngram")]


def hits_of(keys: DataFrame, occurrences: DataFrame, first: DataFrame, places: bool = True) -> DataFrame:
    """Occurrences of a query's keys in its candidates; where places do not matter, a key once for each document.

    A document's occurrences meet the queries that have it as a candidate before they meet keys:
    candidates are so many a query, while a frequent key has occurrences in most of the text and
    belongs to most queries.
    """
    asked = match.few(first.select("query", "doc"))
    if not places:
        occurrences = occurrences.select("ngram", "doc").distinct()
    return occurrences.join(asked, "doc").join(match.few(keys), ["query", "ngram"])


def discounted(hits: DataFrame, options, only: DataFrame | None = None) -> DataFrame:
    """Credit of each key in each document, overlaps allowed: (query, doc, ngram, score, credit, rank). only: (query, doc) to work out.

    hits: distinct (query, doc, ngram, score). A key's credit falls with the share of its token
    types that better keys of the same document have used. A type is new in the first-ranked key
    that holds it, so a minimum per type replaces walking through the keys in order.
    """
    rank = F.dense_rank().over(W.partitionBy("query").orderBy(F.desc("score"), "ngram"))
    order = hits.select("query", "ngram", "score").distinct().withColumn("rank", rank).drop("score")
    if only is not None:
        hits = hits.join(match.few(only.select("query", "doc")), ["query", "doc"], "left_semi")
    ranked = hits.join(order, ["query", "ngram"])
    types = ranked.select("query", "doc", "ngram", "score", "rank", F.explode(F.array_distinct(F.split("ngram", " "))).alias("type"))
    first = F.min("rank").over(W.partitionBy("query", "doc", "type"))
    beta = options.repetition_penalty
    share = F.sum((F.col("rank") == F.col("first")).cast("int")) / F.count("*")
    return (
        types.withColumn("first", first)
        .groupBy("query", "doc", "ngram", "score", "rank")
        .agg(((1 - beta) + beta * share).alias("coeff"))
        .withColumn("credit", F.col("coeff") * F.col("score"))
    )


def candidates(keys: DataFrame, occurrences: DataFrame, options) -> DataFrame:
    """Stage 1: (query, doc, first_score) by rare keys only, cut to the n_docs_complete_score best of each query.

    Without overlaps a key counts where one of its occurrences lies free of better keys; the
    greatest key of a document is taken from all its rare keys, counted or not.
    """
    rare = keys.where("kind = 'rare'")
    at = occurrences.join(rare, "ngram")
    hits = at.select("query", "doc", "ngram", "n", "count", "score").distinct()
    counted = hits if options.allow_overlaps else free_keys(at)
    credits = discounted(counted.select("query", "doc", "ngram", "score"), options)
    summed = credits.groupBy("query", "doc").agg(F.sum("credit").alias("total"))
    greatest = hits.groupBy("query", "doc").agg(F.min_by("score", F.struct(*_ascending(options))).alias("best"))
    score = (1 - options.single_key) * F.coalesce("total", F.lit(0.0)) + options.single_key * F.col("best")
    best = W.partitionBy("query").orderBy(F.desc(F.round("first_score", 9)), "doc")
    return (
        greatest.join(summed, ["query", "doc"], "left")
        .select("query", "doc", score.alias("first_score"))
        .withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= options.n_docs_complete_score)
        .drop("_r")
    )


def _walked(hits: DataFrame, walk) -> DataFrame:
    """(query, doc, ngram, credit) by a function of the sorted occurrences (ngram, score, pos) of each document and query.

    Inherently sequential within a document, so Python; documents follow one another in Arrow
    batches, so there is no cost for each group, and what is held is one document's occurrences.
    """
    group = ["query", "doc"]
    order = [*group, "_s", "ngram", "pos"]
    rows = hits.select(*group, (-F.col("score")).alias("_s"), "ngram", "pos").repartition(*group).sortWithinPartitions(*order)
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def walk_all(batches):
        now, held = None, []
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in order]
            for query, doc, *hit in zip(*columns, strict=True):
                if now != (query, doc):
                    out += [(*now, *x) for x in walk(held)] if held else []
                    now, held = (query, doc), []
                held.append(hit)
            yield _batch(out)
        yield _batch([(*now, *x) for x in walk(held)] if held else [])

    def _batch(rows_: list) -> pa.RecordBatch:
        columns = list(zip(*rows_, strict=True)) if rows_ else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    result = T.StructType([T.StructField("query", kinds["query"]), T.StructField("doc", kinds["doc"]), T.StructField("ngram", T.StringType()), T.StructField("credit", T.DoubleType())])
    schema = to_arrow_schema(result)
    return rows.mapInArrow(walk_all, result)


def free_keys(hits: DataFrame) -> DataFrame:
    """Distinct (query, doc, ngram, score): keys with an occurrence (pos) that no better key's counted occurrence overlaps."""

    def walk(held):
        taken, counted = set(), {}
        for minus, ngram, pos in held:
            places = range(pos, pos + ngram.count(" ") + 1)
            if taken.isdisjoint(places):
                taken.update(places)
                counted.setdefault(ngram, -minus)
        return list(counted.items())

    return _walked(hits, walk).withColumnRenamed("credit", "score")


def full_scores(keys: DataFrame, occurrences: DataFrame, first: DataFrame, unigrams: DataFrame, docs: DataFrame, options) -> DataFrame:
    """Stage 2: (query, doc, score, best_key, best_score) by all keys, for the candidates of stage 1."""
    hits = stored(hits_of(keys, occurrences, first, not (options.allow_overlaps and options.unigrams_ignore_free_places)), "hits")
    if options.allow_overlaps:
        credits = discounted(hits.select("query", "doc", "ngram", "score").distinct(), options).select("query", "doc", "ngram", "credit")
    else:
        credits = greedy(hits.select("query", "doc", "ngram", "score", "pos"), options)
    greatest = hits.groupBy("query", "doc").agg(
        F.min_by("ngram", F.struct(*_ascending(options))).alias("best_key"),
        F.min_by("score", F.struct(*_ascending(options))).alias("best_score"),
    )
    keyed = credits.groupBy("query", "doc").agg(F.sum("credit").alias("total"))
    extra = unigram_credit(credits, unigrams, first, docs, hits, options)
    sk = options.single_key
    return (
        greatest.join(keyed, ["query", "doc"], "left")
        .join(extra, ["query", "doc"], "left")
        .select(
            "query",
            "doc",
            ((1 - sk) * (F.coalesce("total", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0))) + sk * F.col("best_score")).alias("score"),
            "best_key",
            "best_score",
        )
    )


def _ascending(options) -> list:
    out = []
    if options.sort_by_length:
        out.append((-F.col("n")).alias("a"))
    if options.sort_by_freq:
        out.append(F.col("count").alias("b"))
    return [*out, (-F.col("score")).alias("c"), F.col("ngram").alias("d")]


def greedy(hits: DataFrame, options) -> DataFrame:
    """Credit of keys that may not overlap: occurrences in order of (-score, key, position) take free positions."""
    beta = options.repetition_penalty

    def walk(held):
        taken, covered, credit = set(), set(), {}
        for minus, ngram, pos in held:
            toks = ngram.split(" ")
            places, types = range(pos, pos + len(toks)), set(toks)
            new = -minus * (1 - beta + beta * len(types - covered) / len(types)) if covered else -minus
            if new <= 0 or not taken.isdisjoint(places):
                continue
            taken.update(places)
            if ngram not in credit:
                credit[ngram] = new
                covered |= types
        return list(credit.items())

    return _walked(hits, walk)


def unigram_credit(credits, unigrams, first, docs, hits, options) -> DataFrame:
    """(query, doc, extra): scores of single tokens of the candidates that keys leave over, less for types already used."""
    used = credits.select("query", "doc", F.explode(F.array_distinct(F.split("ngram", " "))).alias("token")).distinct().withColumn("used", F.lit(True))
    wanted = first.select("query", "doc").join(unigrams.select("query", "token", "score"), "query")
    # only the candidates' tokens are laid out
    docs = docs.join(first.select("doc").distinct(), "doc", "left_semi")
    present = docs.select("doc", F.explode(F.array_distinct("toks")).alias("token"))
    if not options.unigrams_ignore_free_places:
        spot = hits.select("query", "doc", "ngram", "pos").join(credits.select("query", "doc", "ngram"), ["query", "doc", "ngram"], "left_semi")
        covered = spot.select("query", "doc", F.explode(F.sequence("pos", F.col("pos") + F.size(F.split("ngram", " ")) - 1)).alias("pos")).distinct()
        places = docs.select("doc", F.posexplode("toks").alias("pos", "token"))
        free = wanted.join(places, ["doc", "token"]).join(covered, ["query", "doc", "pos"], "left_anti")
        found = free.select("query", "doc", "token", "score").distinct()
    else:
        found = wanted.join(present, ["doc", "token"])
    coeff = F.when(F.col("used"), 1 - options.repetition_penalty).otherwise(1.0)
    return (
        found.join(used, ["query", "doc", "token"], "left")
        .groupBy("query", "doc")
        .agg(F.sum(coeff * F.col("score")).alias("extra"))
    )


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query with their rank; equal scores go by document."""
    best = W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
