"""The positional index: what a full-text index can be asked, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.functions.ordinals import running, with_ordinal
from loresift.functions.storage import stored
from loresift.functions.text import EOS, with_eos
from loresift.operators import match


class CorpusIndex:
    """An index over sequences of tokens, given as a table (doc, toks); every sequence gets an end token.

    The index is the table itself, stored column by column with its tokens dictionary-coded. A
    saved index holds its postings, sorted by token, and its vocabulary besides; without one they
    are derived where they are needed.
    """

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.saved: str | None = None

    @classmethod
    def build(cls, sequences: DataFrame, doc: str = "doc", toks: str = "toks") -> CorpusIndex:
        """From any table of sequences; integers and other types are written as strings."""
        return cls(sequences.select(F.col(doc).alias("doc"), with_eos(F.col(toks).cast("array<string>")).alias("toks")))

    def save(self, path: str) -> None:
        """Documents with their tokens, postings sorted by token, and the vocabulary: a lookup reads its tokens' row groups only."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        saved = CorpusIndex(self.docs.sparkSession.read.parquet(f"{path}/docs"))
        postings = saved.postings().repartitionByRange("token", "doc").sortWithinPartitions("token", "doc", "pos")
        postings.write.mode("overwrite").parquet(f"{path}/postings")
        saved.vocabulary().orderBy("token").write.mode("overwrite").parquet(f"{path}/vocabulary")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CorpusIndex:
        found = cls(spark.read.parquet(f"{path}/docs"))
        found.saved = path
        return found

    def stored(self) -> CorpusIndex:
        """The index with its tokens written once, for several questions to read."""
        return CorpusIndex(stored(self.docs, "index"))

    def _part(self, name: str) -> DataFrame | None:
        return self.docs.sparkSession.read.parquet(f"{self.saved}/{name}") if self.saved else None

    def postings(self) -> DataFrame:
        saved = self._part("postings")
        return saved if saved is not None else self.docs.select("doc", F.posexplode("toks").alias("pos", "token"))

    def step(self, spots: DataFrame, tokens: DataFrame) -> DataFrame:
        """One token on: spots (ngram, doc, pos of the last token) and tokens (ngram, token) as (ngram, doc, pos) of the longer keys.

        The postings of the tokens asked for meet the spots by document and position, so a key is
        matched token by token, and nothing but its tokens' postings is read.
        """
        later = self.postings().join(match.few(tokens.select("token").distinct()), "token", "left_semi")
        asked = spots.join(tokens, "ngram").select(F.concat_ws(" ", "ngram", "token").alias("ngram"), "doc", "token", (F.col("pos") + 1).alias("pos"))
        return asked.join(later, ["token", "doc", "pos"]).select("ngram", "doc", "pos")

    def vocabulary(self) -> DataFrame:
        """(token, cf, df): occurrences, and documents with one."""
        saved = self._part("vocabulary")
        if saved is not None:
            return saved
        per_doc = self.postings().groupBy("token", "doc").agg(F.count("*").alias("tf"))
        return per_doc.groupBy("token").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))

    def token_counts(self) -> DataFrame:
        """(token, cf), with one shuffle less than the vocabulary."""
        if self.saved:
            return self.vocabulary().select("token", "cf")
        return self.docs.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count("*").alias("cf"))

    def size(self) -> DataFrame:
        """(n_docs, n_tokens), end tokens included."""
        return self.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("toks")), F.lit(0)).alias("n_tokens"))

    def n_tokens(self) -> int:
        return self.size().first().n_tokens

    def numbered(self) -> DataFrame:
        """(doc, doc_idx): ordinals in ascending order of doc."""
        return with_ordinal(self.docs.select("doc"), "doc")

    def lengths(self) -> DataFrame:
        return self.docs.select("doc", F.size("toks").cast("long").alias("length"))

    def beginnings(self) -> DataFrame:
        """(doc, length, beginning): tokens of all documents before."""
        return running(self.lengths(), "doc", "length", "beginning")

    def document_at(self, positions: DataFrame) -> DataFrame:
        """The document of global token positions (at): (at, doc, pos).

        Positions and documents meet in bins of the text, so this is an equi-join however long documents are.
        """
        bin_size = 4096
        spans = self.beginnings().withColumn("end", F.col("beginning") + F.col("length"))
        binned = spans.withColumn(
            "bin",
            F.explode(F.sequence(F.floor(F.col("beginning") / bin_size), F.floor((F.col("end") - 1) / bin_size))),
        )
        asked = positions.select("at", F.floor(F.col("at") / bin_size).alias("bin"))
        return asked.join(binned, "bin").where("at >= beginning and at < end").select(
            "at", "doc", (F.col("at") - F.col("beginning")).alias("pos")
        )

    def occurrences(self, keys: DataFrame, titles: bool = False) -> DataFrame:
        """(ngram, doc, pos) of keys (ngram, n); with titles, keys may start with the end token before a document.

        A saved index answers from its postings, from the keys' first tokens on, one step a token.
        """
        if not self.saved or titles:
            return match.occurrences(self.docs, keys, EOS if titles else None)
        parts = keys.select("ngram", F.split("ngram", " ").alias("t")).distinct()
        longest = parts.agg(F.max(F.size("t"))).first()[0] or 0
        spots, found = None, []
        for n in range(1, longest + 1):
            prefix = F.array_join(F.slice("t", 1, n), " ")
            now = parts.where(F.size("t") >= n)
            if spots is None:
                first = now.select(prefix.alias("token")).distinct()
                spots = self.postings().join(match.few(first), "token").select(F.col("token").alias("ngram"), "doc", "pos")
            else:
                on = now.select(F.array_join(F.slice("t", 1, n - 1), " ").alias("ngram"), F.col("t")[n - 1].alias("token")).distinct()
                spots = self.step(spots, match.few(on))
            ended = parts.where(F.size("t") == n).select("ngram")
            found.append(spots.join(match.few(ended), "ngram", "left_semi").select("ngram", "doc", (F.col("pos") - (n - 1)).alias("pos")))
        return reduce(DataFrame.unionByName, found) if found else match.occurrences(self.docs, keys)

    def counts(self, keys: DataFrame, titles: bool = False) -> DataFrame:
        """(ngram, count) for the keys that occur."""
        return self.occurrences(keys, titles).groupBy("ngram").agg(F.count("*").alias("count"))

    def documents(self, keys: DataFrame) -> DataFrame:
        """Distinct (ngram, doc)."""
        return self.occurrences(keys).select("ngram", "doc").distinct()

    def continuations(self, keys: DataFrame, titles: bool = False) -> DataFrame:
        """(ngram, next, count): the tokens that follow a key, and how often."""
        prefixes = keys.select("ngram", "n").distinct()
        lengths = sorted(r[0] for r in prefixes.select("n").distinct().collect()) or [1]
        found = match.starting(self.docs, prefixes, lengths[-1] + 1, EOS if titles else None)
        # no key of several tokens ends before a document does
        each = F.array(*[F.struct(match.joined(n).alias("ngram"), F.col(f"t{n + 1}").alias("next")) for n in lengths])
        met = found.select("pos", F.inline(each)).where("ngram is not null and next is not null")
        return met.join(match.few(prefixes.select("ngram")), "ngram").groupBy("ngram", "next").agg(F.count("*").alias("count"))

    def extract(self, begin: int = 0, end: int | None = None) -> DataFrame:
        """(doc, toks): tokens begin to end of every document, put together from the postings."""
        part = self.postings().where(F.col("pos") >= begin)
        if end is not None:
            part = part.where(F.col("pos") < end)
        ordered = F.sort_array(F.collect_list(F.struct("pos", "token")))
        return part.groupBy("doc").agg(F.transform(ordered, lambda x: x["token"]).alias("toks"))
