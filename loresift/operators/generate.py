"""Beam search over keys that the corpus holds.

A beam is a row (query, ngram, n, lp). Where the corpus holds beams of two tokens is kept with the
tokens that follow, so later steps read those only, and an impossible key never comes up; the best 2 x beam of a query are all kept
as keys, and the best beam of them that have not ended go on. Steps are few (the length).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loresift.functions.storage import stored
from loresift.functions.text import EOS, drop_second, draw, strip_ends, with_first
from loresift.operators import match


@dataclass
class BeamOptions:
    length: int = 10
    beam: int = 15
    #: Token that ends a key, besides the end of a document.
    end: str = EOS
    topk: int = 0
    stop_at_count: int = 0
    always_allow_eos: bool = False
    forced_prefix: str | None = None
    free: bool = False
    sample: str | None = None
    groups: int = 1
    diversity: float = 0.0
    length_penalty: float = 0.0


def _own(queries: DataFrame, token_counts: DataFrame) -> DataFrame:
    """(query, next, tf, cf) for a query's own tokens that the corpus holds."""
    tf = queries.select("query", F.explode("toks").alias("next")).groupBy("query", "next").agg(F.count("*").alias("tf"))
    return token_counts.withColumnRenamed("token", "next").join(match.few(tf), "next").select("query", "next", "tf", "cf")


def _lookup(beams: DataFrame, n: int, rest: int, index, spots: DataFrame | None, starts: DataFrame | None, forced: str | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """What follows beams of n tokens: (ngram, next, c), and what the next lookup needs: spots (ngram, the ``rest`` tokens after it) and the beams of one token.

    Beams of one token stand nearly everywhere, so only pairs of tokens are counted. From two tokens
    on each place is written down with what follows it, and no document is read again.
    """
    wanted = beams.select("ngram").distinct()
    before = EOS if forced == EOS else None
    if n == 1:
        starts = stored(wanted.withColumnRenamed("ngram", "t1"), "starts")
        pairs = match.beginning(index.docs, starts, 2, before).where("t2 is not null")
        return pairs.groupBy(F.col("t1").alias("ngram"), F.col("t2").alias("next")).agg(F.count("*").alias("c")), None, starts
    if spots is None:
        grown = match.beginning(index.docs, starts, 2, before, rest).where("t2 is not null and size(rest) > 0").select(match.joined(2).alias("ngram"), "rest")
    else:
        grown = spots.where(F.size("rest") > 1).select(F.concat_ws(" ", "ngram", F.col("rest")[0]).alias("ngram"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"))
    spots = stored(grown.join(match.few(wanted), "ngram", "left_semi"), "spots")
    return spots.groupBy("ngram", F.col("rest")[0].alias("next")).agg(F.count("*").alias("c")), spots, starts


def _likely(beams: DataFrame, counted: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """beams with ``next`` and ``cf``: their ``most`` most frequent followers and those that the query holds.

    The others have the probability of their frequency only, so at least ``most`` followers of the
    same beam are likelier, or as likely and before them by name. (Frequencies that rounding to 9
    digits cannot tell apart are over 5e8; ``most`` tokens so frequent need a text of over 1e10.)
    """
    order = W.partitionBy("ngram").orderBy(F.desc("cf"), "next")
    common = counted.select("ngram", "next", "cf").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
    asked = match.few(beams.join(own.select("query", "next"), "query"))
    held = counted.select("ngram", "next", "cf").join(asked, ["ngram", "next"])
    columns = [*beams.columns, "next", "cf"]
    return beams.join(common, "ngram").select(columns).unionByName(held.select(columns)).distinct()


def _any(beams: DataFrame, token_counts: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """As _likely, whatever follows beams in the corpus: its most frequent tokens and the query's own. No end token."""
    tokens = token_counts.where(F.col("token") != EOS).withColumnRenamed("token", "next")
    common = tokens.orderBy(F.desc("cf"), "next").limit(most + 512).select("next", "cf")
    held = beams.join(own.where(F.col("next") != EOS).select("query", "next", "cf"), "query")
    return beams.crossJoin(F.broadcast(common)).unionByName(held.select(*beams.columns, "next", "cf")).distinct()


def _scored(found: DataFrame, own: DataFrame, sizes: DataFrame, total, mu: float) -> DataFrame:
    p = (F.coalesce("tf", F.lit(0)) + F.lit(mu) * F.col("cf") / total) / (F.col("len") + mu)
    return (
        found.join(own.select("query", "next", "tf"), ["query", "next"], "left")
        .join(sizes, "query")
        .withColumn("token_lp", F.log(p))
        .withColumn("score", F.col("lp") + F.col("token_lp"))
        .drop("tf", "len")
    )


def _key(options: BeamOptions, step: int) -> Column:
    """What beams are ordered by; sampled, a score with Gumbel noise."""
    if options.sample is None:
        return F.round("score", 9)
    u = draw(options.sample, F.col("query").cast("string"), F.lit(str(step)), "ngram_", F.col("ngram"), F.col("next"))
    return F.round(F.col("score") - F.log(-F.log(F.greatest(u, F.lit(1e-9)))), 9)


def _drawn(likely: DataFrame, beams: DataFrame, followers: DataFrame, on: list[str], sizes: DataFrame, options: BeamOptions, step: int, total, mu: float) -> DataFrame:
    """likely (scored) with all other followers (ngram, next, cf) that can be drawn; any can.

    The keys of the likely ones say what a query's picks reach at least; of all others only those are
    kept that reach it too, each looked at where it lies, so that nothing is sorted for them. Most
    fail by the first digits of their draw, for which a token's frequency sets the least ones.
    """
    picks = options.groups * _width(options)
    # a penalty or an earlier pick can strike so many of the best
    need = picks if options.groups == 1 else picks * (options.beam + 1)
    ranked = likely.withColumn("_k", _key(options, step)).withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("_k"))))
    least = ranked.where(F.col("_r") == need).select("query", F.col("_k").alias("_least"))
    prefix = F.concat_ws("|", F.lit(options.sample), F.col("query").cast("string"), F.lit(str(step)), F.lit("ngram_"), "ngram", F.lit(""))
    asked = beams.join(sizes, "query").join(least, "query", "left").withColumn("_prefix", prefix).withColumn("_least", F.coalesce("_least", F.lit(-1e300)))
    asked = stored(asked, "asked")
    reach = asked.groupBy(*on).agg(F.min(F.col("_least") - F.col("lp") + F.log(F.col("len") + F.lit(mu))).alias("_reach"))
    share = F.exp(-F.exp(F.log(F.lit(mu) * F.col("cf") / total) - F.col("_reach") + 1e-6))
    digits = F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.floor(share * F.lit(4294967296.0)) - 64).cast("long")), 8, "0"))
    # as many tasks as there are cores at least: what a task holds is few bytes and much work
    spread = followers.repartition(max(64, 3 * beams.sparkSession.sparkContext.defaultParallelism))
    bounded = (spread.join(match.few(reach), on) if on else spread.crossJoin(F.broadcast(reach))).withColumn("_low", digits).drop("_reach")
    met = bounded.join(match.few(asked), on) if on else bounded.crossJoin(match.few(asked))
    near = met.where(F.substring(F.md5(F.concat("_prefix", "next")), 1, 8) >= F.col("_low"))
    p = (F.lit(0) + F.lit(mu) * F.col("cf") / total) / (F.col("len") + mu)
    scored = near.withColumn("token_lp", F.log(p)).withColumn("score", F.col("lp") + F.col("token_lp"))
    reached = scored.where(_key(options, step) >= F.col("_least")).select(likely.columns)
    return likely.unionByName(reached.join(likely.select("query", "ngram", "next"), ["query", "ngram", "next"], "left_anti"))


def _width(options: BeamOptions) -> int:
    return 2 * max(1, options.beam // options.groups)


def _pick(found: DataFrame, options: BeamOptions, step: int) -> DataFrame:
    """The best 2 x beam of each query, group after group if there are several."""
    key, width = _key(options, step), _width(options)
    picked: list[DataFrame] = []
    rest = found
    for group in range(options.groups):
        ranked = rest.withColumn("_g", F.lit(group)).withColumn("_k", key)
        if picked:
            chosen = reduce(DataFrame.unionByName, picked).groupBy("query", "next").agg(F.count("*").alias("_times"))
            ranked = ranked.join(chosen, ["query", "next"], "left").withColumn("_k", F.col("_k") - options.diversity * F.coalesce("_times", F.lit(0))).drop("_times")
        best = W.partitionBy("query").orderBy(F.desc("_k"), "ngram", "next")
        now = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= width).drop("_k")
        picked.append(now)
        if group + 1 < options.groups:
            rest = rest.join(now.select("query", "ngram", "next"), ["query", "ngram", "next"], "left_anti")
    return reduce(DataFrame.unionByName, picked)


def generate(queries: DataFrame, index, token_counts: DataFrame, total, options: BeamOptions, mu: float = 10.0) -> DataFrame:
    """Keys (query, ngram, n, lp, step, rank) for queries (query, toks); lp is divided by n ** length_penalty.

    Every step's beams are stored: their lineage is cut, and their reader reads one and the same draw.
    """
    queries = queries.where(F.size("toks") > 0)
    most = max(2 * options.beam, options.groups * _width(options), options.topk)
    start = queries.select("query", F.lit(options.forced_prefix or "").alias("ngram"), F.lit(1 if options.forced_prefix else 0).alias("n"), F.lit(0.0).alias("lp"))
    sizes = queries.select("query", F.size("toks").alias("len"))
    own = stored(_own(queries, token_counts), "own")
    beams, kept = start, []
    spots = starts = None
    for step in range(1, options.length + 1):
        if (step == 1 and not options.forced_prefix) or options.free:
            followers, on = token_counts.where(F.col("token") != EOS).withColumnRenamed("token", "next"), []
            found = _any(beams, token_counts, own, most)
        else:
            n = step if options.forced_prefix else step - 1
            counted, spots, starts = _lookup(beams, n, options.length - step + 1, index, spots, starts, options.forced_prefix)
            counted = stored(token_counts.withColumnRenamed("token", "next").join(match.few(stored(counted, "followers")), "next"), "counted")
            if options.stop_at_count:
                often = counted.groupBy("ngram").agg(F.sum("c").alias("c")).where(F.col("c") > options.stop_at_count)
                counted = counted.join(match.few(often.select("ngram")), "ngram", "left_semi")
            followers, on = counted.select("ngram", "next", "cf"), ["ngram"]
            found = _likely(beams, counted, own, most)
            if options.always_allow_eos:
                end = token_counts.where(F.col("token") == EOS).select(F.col("token").alias("next"), "cf")
                found = found.unionByName(beams.crossJoin(F.broadcast(end)).select(found.columns)).distinct()
        found = _scored(found, own, sizes, total, mu)
        if options.topk:
            per_beam = W.partitionBy("query", "ngram")
            found = found.withColumn("_t", F.row_number().over(per_beam.orderBy(F.desc(F.round("token_lp", 9)), "next"))).where(F.col("_t") <= options.topk)
            found = found.withColumn("token_lp", F.col("token_lp") - F.log(F.sum(F.exp("token_lp")).over(per_beam))).drop("_t")
            found = found.withColumn("score", F.col("lp") + F.col("token_lp"))
        elif options.sample is not None:
            found = _drawn(stored(found, "likely"), beams, followers, on, sizes, options, step, total, mu)
        best = _pick(found, options, step).select(
            "query",
            F.concat_ws(" ", F.nullif("ngram", F.lit("")), "next").alias("ngram"),
            (F.col("n") + 1).alias("n"),
            F.col("score").alias("lp"),
            F.lit(step).alias("step"),
            "rank",
            F.col("next").isin(EOS, options.end).alias("ended"),
            "_g",
        )
        best = stored(best, "beams")
        kept.append(best)
        alive = W.partitionBy("query", "_g").orderBy("rank")
        width = max(1, options.beam // options.groups)
        beams = (
            best.where("not ended")
            .withColumn("_a", F.row_number().over(alive))
            .where(F.col("_a") <= width)
            .select("query", "ngram", "n", "lp")
        )
        if step < options.length and beams.isEmpty():
            break
    every = reduce(DataFrame.unionByName, kept)
    return every.select("query", "ngram", "n", (F.col("lp") / F.pow("n", F.lit(options.length_penalty))).alias("lp"), "step", "rank")


def _cut(keys: DataFrame, toks: Column) -> DataFrame:
    cut = keys.select("query", toks.alias("toks"), "lp").where(F.size("toks") > 0)
    return cut.select("query", F.array_join("toks", " ").alias("ngram"), F.size("toks").alias("n"), "lp")


def body_keys(keys: DataFrame, exactly: int = 0, special: tuple[str, ...] = (EOS,)) -> DataFrame:
    """Generated keys without special tokens at their ends (two in front, one behind at most); of one length only, if asked."""
    toks = F.split("ngram", " ")
    for _ in range(2):
        toks = F.when(F.try_element_at(toks, F.lit(1)).isin(*special), F.slice(toks, 2, F.size(toks))).otherwise(toks)
    return of_length(_cut(keys, strip_ends(toks, [], list(special))), exactly)


def title_keys(keys: DataFrame, first: str, end: str, partial: bool = False, exactly: int = 0, forced_second: bool = False) -> DataFrame:
    """Keys generated from a title's first token: without a forced second token, complete unless partial, with the first token in front."""
    toks = F.split("ngram", " ")
    found = keys.where(F.size(toks) >= 3) if forced_second else keys
    cut = _cut(found, drop_second(toks) if forced_second else toks)
    if not partial:
        cut = of_length(cut.where(F.try_element_at(F.split("ngram", " "), F.lit(-1)) == end), exactly + 1 if exactly else 0)
    return _cut(cut, with_first(F.split("ngram", " "), first))


def code_keys(keys: DataFrame, first: str, end: str, partial: bool = False, forced_second: bool = False) -> DataFrame:
    """Keys generated from a code's first token, which is taken off and put back; complete unless partial."""
    toks = F.split("ngram", " ")
    found = keys.where(F.size(toks) >= 2) if forced_second else keys
    toks = drop_second(toks) if forced_second else toks
    cut = _cut(found, F.slice(toks, 2, F.size(toks)))
    if not partial:
        cut = cut.where(F.try_element_at(F.split("ngram", " "), F.lit(-1)) == end)
    return _cut(cut, with_first(F.split("ngram", " "), first))


def of_length(keys: DataFrame, n: int) -> DataFrame:
    """Keys of n tokens; all, if n is 0."""
    return keys.where(F.col("n") == n) if n else keys
