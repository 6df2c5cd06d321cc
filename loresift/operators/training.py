"""Pairs of sources and targets for training a key generator."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresift.functions.storage import stored
from loresift.functions.text import STOPWORDS, TITLE_END, draw, is_good

KINDS = ("span", "chunk", "title", "code")


def within(contexts: DataFrame, max_rank: int = 1, min_score: float = 999, min_score_gold: float = 999) -> DataFrame:
    """Positive contexts (sample, rank, score, title_score, ...) by rank and scores; gold ones score min_score_gold or more."""
    return contexts.where(
        (F.col("rank") <= max_rank) & ((F.col("score") >= min_score) | (F.col("title_score") >= min_score_gold))
    )


def limited(contexts: DataFrame, kb: DataFrame, limit: int) -> DataFrame:
    """Contexts (sample, place, key) found in a knowledge base (key, title, text): the first ``limit`` found of each sample."""
    order = W.partitionBy("sample").orderBy("place")
    found = contexts.join(kb, "key")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def mark(source: str, target: str, silver=None) -> Column:
    """Source with its target's kind, and with its trust if asked: `` || +`` for gold, `` || ?`` for silver."""
    kinds = {"span": " || body", "chunk": " || body", "title": " || title", "code": " || code"}
    out = F.concat(F.lit(" "), F.trim(F.col(source)), F.lit(kinds[target]))
    if silver is None:
        return out
    return F.concat(out, F.when(silver, F.lit(" || ?")).otherwise(F.lit(" || +")))


def target(kind: str, title="title", text="text", code="code"):
    return {
        "chunk": F.concat(F.lit(" "), F.col(text)),
        "span": F.concat(F.lit(" "), F.col(text)),
        "title": F.concat(F.lit(" "), F.col(title), F.lit(f" {TITLE_END}")),
        "code": F.concat(F.lit(" "), F.col(code), F.lit(" ||")),
    }[kind]


def with_codes(pairs: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Pairs with their code; those without one, or with an empty one, go."""
    return pairs.join(codes.where(F.coalesce(F.length("code"), F.lit(0)) > 0), key)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two strings in hundredths: 2 x matching characters / all characters."""
    return pd.Series([round(100 * SequenceMatcher(None, x, y).ratio()) / 100 for x, y in zip(a, b, strict=True)])


def _starts(toks: str, words: int) -> Column:
    """The ``words`` words from each position on, in lower case; fewer at the end."""
    t = F.transform(F.col(toks), F.lower)
    return F.transform(t, lambda _, i: F.array_join(F.slice(t, i + 1, words), " "))


def span_weights(pairs: DataFrame, temperature: float = 1.0, words: int = 3, stop: Sequence[str] = STOPWORDS) -> DataFrame:
    """(pair, start, weight, p): how alike the question a span of the passage is, as a softmax over the passage.

    pairs: (pair, question array, passage array); of a question, what stands before a ``||`` counts.
    A start weighs the likeness of the ``words`` words there, in lower case, to those from every word
    of the question on. Passages start on no word of ``stop``. Where nothing is alike the start is 0,
    of weight 0; where there is nothing to compare, too, of no weight.
    """
    until = F.array_position("question", "||").cast("int")
    asked = pairs.withColumn("question", F.when(until > 0, F.slice("question", F.lit(1), F.greatest(until - 1, F.lit(0)))).otherwise(F.col("question")))
    passage = asked.select("pair", F.posexplode(_starts("passage", words)).alias("start", "b"))
    passage = passage.where(~F.element_at(F.split("b", " "), 1).isin(list(stop)))
    weights = (
        passage.join(asked.select("pair", F.explode(_starts("question", words)).alias("a")), "pair")
        .groupBy("pair", "start")
        .agg(F.sum(ratio("a", "b")).alias("weight"))
    )
    weights = stored(weights, "weights")
    whole = W.partitionBy("pair")
    share = F.exp((F.col("weight") - F.max("weight").over(whole)) / temperature)
    weighed = weights.withColumn("e", share).withColumn("all", F.sum("weight").over(whole)).withColumn("p", F.col("e") / F.sum("e").over(whole))
    alike = weighed.where("all > 0").select("pair", "start", "weight", "p")
    none = weighed.where("all = 0").select("pair", F.lit(0).alias("start"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("p")).distinct()
    bare = pairs.select("pair").join(weights.select("pair").distinct(), "pair", "left_anti")
    return alike.unionByName(none).unionByName(bare.select("pair", F.lit(0).alias("start"), F.lit(None).cast("double").alias("weight"), F.lit(1.0).alias("p")))


def sample_spans(weights: DataFrame, pairs: DataFrame, n: int, seed: str, least: int = 10, most: int = 10) -> DataFrame:
    """(pair, draw, start, span): n draws with replacement for each pair, by inverting the cumulative weights, of least to most words.

    A pair without weights is drawn from once.
    """
    order = W.partitionBy("pair").orderBy("start")
    upper = F.sum("p").over(order.rowsBetween(W.unboundedPreceding, 0))
    cumulated = weights.withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col("p"))
    last = F.max("start").over(W.partitionBy("pair"))
    times = F.when(F.col("weight").isNull(), 1).otherwise(n)
    draws = cumulated.withColumn("last", last).withColumn("draw", F.explode(F.sequence(F.lit(1), times)))
    u = draw(seed, F.col("pair").cast("string"), F.col("draw").cast("string"))
    beyond = (F.col("start") == F.col("last")) & (F.col("u") >= F.col("upper"))
    drawn = draws.withColumn("u", u).where((F.col("u") >= F.col("lower")) & ((F.col("u") < F.col("upper")) | beyond))
    size = least + F.floor(draw(seed, F.lit("size"), F.col("pair").cast("string"), F.col("draw").cast("string")) * (most - least + 1)).cast("int")
    span = F.array_join(F.slice("passage", F.col("start") + 1, size), " ")
    return drawn.join(pairs.select("pair", "passage"), "pair").select("pair", "draw", "start", span.alias("span"))


@dataclass
class Lengths:
    """Words of sources and targets, least and most."""

    source: tuple[int, int] = (10, 10)
    target: tuple[int, int] = (10, 10)


def random_pairs(
    docs: DataFrame, n: int, seed: str, titles: int = 0, lengths: Lengths = Lengths(), tries: int = 10,
    pretraining: bool = False, delimiter: str = TITLE_END, stop: Sequence[str] = STOPWORDS,
) -> DataFrame:
    """(doc, kind, nth, source, target): ``n`` body pairs and ``titles`` title pairs of each document (doc, title, text, toks).

    A body pair is two spans that do not start at one place. A title pair is, as a coin falls, a span
    and the title or the title and a span. Draws whose target starts on a bad word fail; they go on
    until there are enough or ``tries`` have failed. A tenth of the sources is lower-cased.
    Documents whose text is their title, or has no words, have no pairs.
    """
    body, title = F.lit("body"), F.lit("title")
    rows = docs.where((F.col("text") != F.col("title")) & (F.size("toks") > 0))
    plan = F.array(F.struct(body.alias("kind"), F.lit(n).alias("want")), F.struct(title.alias("kind"), F.lit(titles).alias("want")))
    wanted = rows.select("doc", "title", "toks", F.inline(plan)).where("want > 0")
    draws = wanted.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("want") + tries - 1)))

    def u(*what):
        return draw(seed, *[F.lit(w) for w in what], F.col("kind"), F.col("doc").cast("string"), F.col("draw").cast("string"))

    def span(which: str, low: int, high: int):
        size = (low + F.floor(u(which, "size") * (high - low + 1))).cast("int")
        room = F.greatest(F.lit(0), F.size("toks") - size) + 1
        return F.floor(u(which) * room).cast("int").alias(which), size.alias(f"{which}_size")

    placed = draws.select("*", *span("s", *lengths.source), *span("t", *lengths.target), (u("coin") >= 0.5).alias("to_title"))
    to_title = (F.col("kind") == title) & F.col("to_title")
    good = is_good(F.element_at("toks", F.col("t") + 1), stop)
    ok = F.when(to_title, True).when(F.col("kind") == title, good).otherwise(good & (F.col("s") != F.col("t")))
    source_span = F.array_join(F.slice("toks", F.col("s") + 1, F.col("s_size")), " ")
    target_span = F.array_join(F.slice("toks", F.col("t") + 1, F.col("t_size")), " ")
    source = F.when((F.col("kind") == title) & ~F.col("to_title"), F.trim("title")).otherwise(source_span)
    mark_ = F.when(to_title, F.lit(" || title")).otherwise(F.lit(" || body"))
    source = F.concat(source, mark_, F.lit(" || p" * pretraining))
    target_ = F.when(to_title, F.concat(F.trim("title"), F.lit(f" {delimiter}"))).otherwise(target_span)
    # spans are cut here: a document's tokens are not moved for each of its draws
    good_ones = placed.where(ok).select("doc", "kind", "want", "draw", source.alias("source"), target_.alias("target"))
    order = W.partitionBy("doc", "kind").orderBy("draw")
    # a draw counts with those of its own number, as a running sum over all draws would count it
    counted = good_ones.withColumn("nth", F.count("*").over(order.rangeBetween(W.unboundedPreceding, 0)).cast("int"))
    failed = F.col("draw") - F.col("nth")
    kept = counted.where((F.col("nth") <= F.col("want")) & (failed < tries))
    return kept.select("doc", "kind", "nth", F.when(u("case") < 0.1, F.lower("source")).otherwise(F.col("source")).alias("source"), "target")


def full_document_pairs(docs: DataFrame, copies: int = 1, pretraining: bool = False) -> DataFrame:
    """(doc, copy, source, target): whole text to title, ``copies`` times; docs whose text is their title go."""
    source = F.concat(F.trim("text"), F.lit(" || title" + " || p" * pretraining))
    return docs.where("text <> title").select(
        "doc", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"), source.alias("source"), F.concat(F.trim("title"), F.lit(f" {TITLE_END}")).alias("target")
    )


def encoded_lines(lines: DataFrame, path: str, keep_empty: bool = False) -> DataFrame:
    """lines (source, target, ...) with their token ids, space-joined, by the tokenizers file at path, and ``filter``: PASS, or EMPTY where either is blank."""

    @F.pandas_udf(T.StringType())
    def encode(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        return texts.map(lambda t: " ".join(map(str, encoder.encode(t.rstrip(), add_special_tokens=False).ids)))

    blank = F.lit(False)
    for side in ("source", "target"):
        blank = blank | ~F.coalesce(F.col(side), F.lit("")).rlike(r"\S")
    kept = F.lit("PASS") if keep_empty else F.when(blank, "EMPTY").otherwise("PASS")
    ids = {side: encode(F.coalesce(side, F.lit(""))) for side in ("source", "target")}
    return lines.withColumn("filter", kept).withColumns(ids)


def decoded_lines(lines: DataFrame, path: str, column: str = "line") -> DataFrame:
    """lines of space-joined token ids as text."""

    @F.pandas_udf(T.StringType())
    def decode(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        decoder = Tokenizer.from_file(path)
        return texts.map(lambda t: decoder.decode([int(x) for x in t.split()], skip_special_tokens=False))

    return lines.withColumn(column, decode(column))


def filter_statistics(lines: DataFrame, least: int, most: int) -> DataFrame:
    """(reason, n): lines that an encoder would keep or drop, and why. lines: (line)."""
    n = F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w != ""))
    reason = F.when(n == 0, "empty").when(n < least, "short").when(n > most, "long").otherwise("kept")
    return lines.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
