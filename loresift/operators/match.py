"""Finding keys (runs of tokens) in documents by equi-joins.

Two plans give the same occurrences. By explosion: the documents' tokens are laid out next to
those that follow them, positions without a key's first token go, and the runs of the keys'
lengths that are left meet the keys; nothing is shuffled while the keys are few enough to
broadcast, which is counted first. By rarest token: each key meets the postings of its rarest
token only, and the tokens around are compared in each document once; made for long keys, whose
runs would multiply the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loresift.functions.storage import stored

#: Keys up to this many are sent to every executor.
BROADCAST_KEYS = 500_000
#: Keys up to this length are found by explosion.
SHORT = 4
#: Tokens of a document that are laid out at a time.
PIECE = 1024


def runs(docs: DataFrame, lengths: list[int], eos_before: str | None = None) -> DataFrame:
    """All runs of the given lengths: (doc, pos, ngram). docs: (doc, toks).

    With eos_before, runs of two tokens or more may also start at position -1 with that token:
    the end of the document before.
    """

    def of(n: int):
        first = -1 if eos_before and n > 1 else 0
        toks = F.concat(F.array(F.lit(eos_before)), "toks") if first else F.col("toks")
        found = F.transform(
            F.sequence(F.lit(1), F.size(toks) - n + 1),
            lambda i: F.struct((i - 1 + first).alias("pos"), F.array_join(F.slice(toks, i, n), " ").alias("ngram")),
        )
        return F.when(F.size(toks) >= n, found).otherwise(F.array().cast("array<struct<pos:int,ngram:string>>"))

    return docs.select("doc", F.inline(F.flatten(F.array(*[of(n) for n in lengths]))))


def is_few(keys: DataFrame) -> bool:
    return keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if is_few(keys) else keys


def windows(docs: DataFrame, n: int, eos_before: str | None = None) -> DataFrame:
    """Every token with those after it: (doc, pos, t1, ..., tn); null beyond a document's end. With eos_before, positions start at -1."""
    toks = F.concat(F.array(F.lit(eos_before)), "toks") if eos_before else F.col("toks")
    # long documents in pieces, each with the n - 1 tokens after it: what a row lays out is bounded
    begins = F.sequence(F.lit(0), F.greatest(F.size("toks") - 1, F.lit(0)), F.lit(PIECE))
    cut = F.transform(begins, lambda b: F.struct(b.alias("begin"), F.slice("toks", b + 1, F.lit(PIECE + n - 1)).alias("toks")))
    laid = docs.select("doc", toks.alias("toks")).select("doc", F.inline(cut))
    columns = [F.slice("toks", k, F.lit(PIECE)).alias(f"t{k}") for k in range(1, n + 1)]
    rows = laid.select("doc", "begin", F.posexplode(F.arrays_zip(*columns)).alias("at", "w")).withColumn("pos", F.col("begin") + F.col("at"))
    first = -1 if eos_before else 0
    return rows.select("doc", (F.col("pos") + first).cast("int").alias("pos"), "w.*")


def starting(docs: DataFrame, keys: DataFrame, n: int, eos_before: str | None = None) -> DataFrame:
    """The windows of n tokens that start with the first token of one of the keys (ngram)."""
    return beginning(docs, keys.select(F.element_at(F.split("ngram", " "), 1).alias("t1")).distinct(), n, eos_before)


def beginning(docs: DataFrame, first: DataFrame, n: int, eos_before: str | None = None, rest: int = 0) -> DataFrame:
    """The windows of n tokens that start with one of the tokens ``first`` (t1); if asked, with an array of the ``rest`` tokens after them.

    Where the tokens are few, positions meet them as they are laid out, and only those that are left
    take the tokens after them from their document, which is not copied; else windows are laid out whole.
    """
    if not is_few(first):
        after = F.filter(F.array(*[F.col(f"t{n + k}") for k in range(1, rest + 1)]), lambda t: t.isNotNull())
        found = windows(docs, n + rest, eos_before).join(first, "t1", "left_semi")
        return found.select("doc", "pos", *[f"t{k}" for k in range(1, n + 1)], *[after.alias("rest")] * bool(rest))
    toks = F.concat(F.array(F.lit(eos_before)), "toks") if eos_before else F.col("toks")
    found = docs.select("doc", toks.alias("toks")).select("doc", "toks", F.posexplode("toks").alias("at", "t1")).join(F.broadcast(first), "t1", "left_semi")
    later = [F.get("toks", F.col("at") + k).alias(f"t{k + 1}") for k in range(1, n)]
    after = F.slice("toks", F.col("at") + n + 1, F.lit(rest))
    return found.select("doc", (F.col("at") - F.lit(1 if eos_before else 0)).cast("int").alias("pos"), "t1", *later, *[after.alias("rest")] * bool(rest))


def joined(n: int) -> Column:
    """The first n tokens of a window as one string; null where it is shorter."""
    columns = [F.col(f"t{k}") for k in range(1, n + 1)]
    return F.when(columns[-1].isNotNull(), F.concat_ws(" ", *columns))


def by_explosion(docs: DataFrame, keys: DataFrame, eos_before: str | None = None) -> DataFrame:
    keys = stored(keys.select("ngram", "n").distinct(), "keys")
    lengths = sorted(r[0] for r in keys.select("n").distinct().collect()) or [1]
    found = starting(docs, keys, lengths[-1], eos_before)
    if eos_before:
        # the end token alone belongs to its document's end
        each = F.array(*[F.when((F.col("pos") >= 0) | F.lit(n > 1), joined(n)) for n in lengths])
    else:
        each = F.array(*[joined(n) for n in lengths])
    return found.select("doc", "pos", F.explode(each).alias("ngram")).join(few(keys.select("ngram")), "ngram").select("ngram", "doc", "pos")


def by_rarest_token(docs: DataFrame, keys: DataFrame) -> DataFrame:
    docs = stored(docs, "documents")
    postings = docs.select("doc", F.posexplode("toks").alias("pos", "token"))
    pieces = stored(keys.select("ngram", F.posexplode(F.split("ngram", " ")).alias("off", "token")), "pieces")
    # only the keys' tokens are counted
    asked = few(pieces.select("token").distinct())
    counts = docs.select(F.explode("toks").alias("token")).join(asked, "token", "left_semi").groupBy("token").count()
    order = W.partitionBy("ngram").orderBy(F.col("count").asc_nulls_first(), "off")
    rarest = (
        pieces.join(counts, "token", "left").withColumn("r", F.row_number().over(order)).where("r = 1 and count is not null")
    )
    wanted = stored(rarest.select("ngram", "off", "token"), "rarest")
    if is_few(wanted):
        # keys come to where documents lie: tokens around are compared there, and nothing is moved
        sized = F.broadcast(wanted.withColumn("n", F.size(F.split("ngram", " "))))
        here = docs.select("doc", "toks", F.posexplode("toks").alias("at", "token")).join(sized, "token").where("at >= off")
        same = F.array_join(F.slice("toks", F.col("at") - F.col("off") + 1, F.col("n")), " ") == F.col("ngram")
        return here.where(same).select("ngram", "doc", (F.col("at") - F.col("off")).alias("pos"))
    # positions first, a document's tokens once: they are not copied to every posting
    starts = postings.join(wanted, "token").select("doc", F.struct("ngram", (F.col("pos") - F.col("off")).alias("pos")).alias("s")).where("s.pos >= 0")
    spots = starts.groupBy("doc").agg(F.collect_list("s").alias("spots"))

    def holds(s):
        return F.array_join(F.slice("toks", s["pos"] + 1, F.size(F.split(s["ngram"], " "))), " ") == s["ngram"]

    held = docs.join(spots, "doc").select("doc", F.inline(F.filter("spots", holds)))
    return held.select("ngram", "doc", "pos")


def occurrences(docs: DataFrame, keys: DataFrame, eos_before: str | None = None) -> DataFrame:
    """Every occurrence (ngram, doc, pos) of keys (ngram, n) in docs (doc, toks), overlapping ones included."""
    longest = keys.agg(F.max("n")).first()[0] or 1
    if eos_before or longest <= SHORT:
        return by_explosion(docs, keys, eos_before)
    return by_rarest_token(docs, keys)


def as_keys(ngrams: DataFrame) -> DataFrame:
    """Distinct (ngram, n) of a table with a column ngram."""
    return ngrams.select("ngram", F.size(F.split("ngram", " ")).alias("n")).distinct()


def run_counts(rows: DataFrame, sequence: str, order: list[str], token: str, n: int) -> DataFrame:
    """(ngram, count) of every run of n tokens of sequences given as rows: as counting all of them as keys, but no sequence is put together and no key looked up."""
    following = [F.lead(F.col(token).cast("string"), k).over(W.partitionBy(sequence).orderBy(*order)).alias(f"t{k}") for k in range(n)]
    each = [F.col(token).cast("string").alias("t0"), *following[1:]]
    runs_ = rows.select(*each).where(F.col(f"t{n - 1}").isNotNull())
    parts = [p for k in range(n) for p in (F.lit(" "), F.col(f"t{k}"))][1:]
    return runs_.groupBy(F.concat(*parts).alias("ngram")).agg(F.count("*").alias("count"))
