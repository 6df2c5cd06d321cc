"""Search: keys of queries, their evidence, ranked documents."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.functions.storage import stored
from loresift.functions.text import EOS, TITLE_END, clean, column, has_text, prompt, repair, split_at, subwords, tokens, with_title, words
from loresift.operators import evidence, keys, match
from loresift.operators import generate as generation
from loresift.operators.generate import BeamOptions
from loresift.operators.index import CorpusIndex

#: Longest title or code that is generated.
TITLE_LENGTH = 15


@dataclass
class Options:
    """Parameters of search, with the usual defaults."""

    length: int = 10
    min_length: int = 0
    beam: int = 15
    length_penalty: float = 0.0
    repetition_penalty: float = 0.8
    score_exponent: float = 2.0
    max_occurrences_1: int = 1500
    max_occurrences_2: int = 10_000_000
    n_docs_complete_score: int = 1500
    add_query_to_keys: bool = True
    query_span: int = 3
    capitals: bool = False
    #: Keys from bodies, from the starts of documents (titles) and from codes, by beam search.
    generate_keys: bool = False
    decode_titles: bool = False
    decode_code: bool = False
    partial_titles: bool = False
    partial_code: bool = False
    free_generation: bool = False
    #: Whether titles and codes carry a second token that the generator is made to begin with.
    forced_second_token: bool = False
    title_end: str = TITLE_END
    code_first: str = "||"
    code_end: str = "||"
    #: Score all keys by the scorer, instead of by the beams they come from.
    rescore: bool = False
    #: What the query is asked with: see loresift.functions.text.prompt.
    prepend_space: bool = True
    use_markers: bool = True
    value_conditioning: bool = True
    use_index_frequency: bool = True
    unigram_scores: bool = True
    add_best_unigrams: bool = True
    top_k_unigrams: int = 5000
    sort_by_length: bool = False
    sort_by_freq: bool = False
    allow_overlaps: bool = False
    single_key: float = 0.0
    unigrams_ignore_free_places: bool = False
    smoothing: float = 5.0
    #: Scores are rounded to so many digits, so that equal evidence ties whatever order it was summed in.
    digits: int = 6
    decode: BeamOptions = field(default_factory=BeamOptions)


def build_corpus(
    rows: DataFrame, include_title: bool = True, delimiter: str = TITLE_END, lowercase: bool = False, doc: str = "id",
    fix: bool = False, split_words: bool = False, tokenizer: str | None = None,
) -> DataFrame:
    """(doc, title, text, toks) from (id, title, text): cleaned, empty texts dropped, title in front if asked.

    fix: repair text that was decoded wrongly. split_words: set words and marks apart. tokenizer: a
    tokenizers file, by whose pieces texts are cut instead of at white space.
    """
    for on, change in ((fix, repair), (split_words, words)):
        if on:
            rows = rows.withColumns({c: change(F.col(c)) for c in ("title", "text")})
    text = rows.where(has_text("text")).withColumn("text", clean("text"))
    full = with_title("title", "text", delimiter) if include_title else column("text")
    toks = subwords(F.lower(full) if lowercase else full, tokenizer) if tokenizer else tokens(full, lowercase, cleaned=not include_title)
    return text.select(F.col(doc).alias("doc"), "title", "text", toks.alias("toks"))


class Searcher:
    """Answers queries from an index. Queries are a table (query, toks); results are tables."""

    def __init__(self, index: CorpusIndex, options: Options | None = None, scorer=None):
        self.index = index
        self.options = options or Options()
        self.scorer = scorer or keys.CountScorer()

    @classmethod
    def load(cls, spark: SparkSession, path: str, options: Options | None = None, scorer=None) -> Searcher:
        return cls(CorpusIndex.load(spark, path), options, scorer)

    def generate_keys(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Scored-by-model keys (query, ngram, n, lp) and unigrams (query, token, cf, lp) of queries."""
        o = self.options
        counts = stored(self.index.token_counts(), "counts")
        total = F.lit(float(self.index.n_tokens()))
        sources = []
        if o.add_query_to_keys:
            spans = generation.of_length(keys.query_keys(queries, o.query_span, o.capitals), o.min_length)
            asked = self.prompted(queries, "body")
            sources.append((self.scorer.keys(asked, spans, counts, total), 2, True))
        if o.generate_keys:
            asked = self.prompted(queries, "body")
            made = self._made(asked, counts, total, replace(o.decode, length=o.length, beam=o.beam, length_penalty=o.length_penalty))
            sources.append((generation.body_keys(made, o.min_length), 1, False))
        if o.decode_titles:
            made = self._made(self.prompted(queries, "title"), counts, total, replace(o.decode, length=TITLE_LENGTH, beam=o.beam, forced_prefix=EOS, end=o.title_end))
            sources.append((generation.title_keys(made, EOS, o.title_end, o.partial_titles, o.min_length, o.forced_second_token), 3, False))
        if o.decode_code:
            made = self._made(self.prompted(queries, "code"), counts, total, replace(o.decode, length=TITLE_LENGTH, beam=o.beam, forced_prefix=o.code_first, end=o.code_end))
            sources.append((generation.code_keys(made, o.code_first, o.code_end, o.partial_code, o.forced_second_token), 4, False))
        if not sources:
            raise ValueError("no source of keys is chosen")
        every = []
        for found, source, scored in sources:
            found = found.select("query", "ngram", "n", "lp")
            if o.rescore and not scored:
                bare = found.select("query", "ngram", F.col("n").cast("int").alias("n")).distinct()
                found = self.scorer.keys(queries, bare, counts, total).select("query", "ngram", "n", "lp")
            every.append(found.withColumn("source", F.lit(source)))
        union = reduce(DataFrame.unionByName, every)
        return keys.first_of_each(union, ["source", F.desc("lp")]).drop("source"), self.scorer.unigrams(self.prompted(queries, "body"), counts, total)

    def prompted(self, queries: DataFrame, kind: str) -> DataFrame:
        """Queries with ``prompt``, the text that a generator of keys of this kind is asked."""
        o = self.options
        return queries.withColumn("prompt", prompt(F.array_join("toks", " "), kind, o.prepend_space, o.use_markers, o.value_conditioning))

    def _made(self, queries: DataFrame, counts: DataFrame, total, options: BeamOptions) -> DataFrame:
        return generation.generate(queries, self.index, counts, total, replace(options, free=options.free or self.options.free_generation))

    def retrieve(self, found: DataFrame, unigrams: DataFrame | None, k: int) -> DataFrame:
        """The k best documents (query, doc, score, best_key, best_score, rank) for keys from anywhere."""
        o = self.options
        total = F.lit(float(self.index.n_tokens()))
        titles = o.decode_titles
        at = stored(self.index.occurrences(match.as_keys(found), titles), "occurrences")
        counts = at.groupBy("ngram").agg(F.count("*").alias("count"))
        scored = keys.score_keys(found, counts, total, o).select("query", "ngram", "n", "count", "score")
        singles = keys.score_unigrams(unigrams, found, total, o) if o.unigram_scores and unigrams is not None else None
        if singles is not None and o.add_best_unigrams:
            scored = keys.add_best_unigrams(scored, singles)
            more = self.index.occurrences(match.as_keys(singles.select(F.col("token").alias("ngram"))))
            at = at.unionByName(more).distinct()
        split = stored(keys.split_by_frequency(scored, o).where("score > 0"), "keys")
        first = stored(evidence.candidates(split, at, o), "candidates")
        if singles is None:
            singles = split.limit(0).select("query", F.col("ngram").alias("token"), "score")
        return evidence.top(evidence.full_scores(split, at, first, singles, self.index.docs, o), k)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return self.retrieve(*self.generate_keys(queries), k)

    def doc(self, doc) -> DataFrame:
        return self.index.docs.where(F.col("doc") == F.lit(doc))

    def parts(self, docs: DataFrame) -> DataFrame:
        """docs (doc, ...) with their title and body tokens, parted at the title's end."""
        split = split_at("toks", self.options.title_end)
        return docs.join(self.index.docs.select("doc", split.alias("_p")), "doc").select(*docs.columns, "_p.title", "_p.body")
