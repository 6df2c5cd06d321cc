"""Command line: ``python -m loresift build`` and ``python -m loresift search``."""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.functions.text import split_at, tokens
from loresift.operators.index import CorpusIndex
from loresift.plans.search import Options, Searcher, build_corpus
from loresift.sources import readers, writers

CORPORA = {"kilt": readers.corpus_tsv, "dpr": readers.passages_tsv}
SIMPLE = (int, float, bool, str)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loresift")
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="build and save an index from a corpus file")
    build.add_argument("input")
    build.add_argument("output")
    build.add_argument("--format", choices=list(CORPORA), default="kilt")
    build.add_argument("--delim", default="@@")
    build.add_argument("--tokenizer", help="a tokenizers file; words at white space where there is none")
    for flag in ("include_title", "lowercase", "tokenize", "fix"):
        build.add_argument(f"--{flag}", action="store_true")
    search = commands.add_parser("search", help="answer topics from an index")
    search.add_argument("--index", required=True)
    search.add_argument("--topics", required=True)
    search.add_argument("--topics_format", choices=list(readers.TOPICS), default="default")
    search.add_argument("--output", required=True)
    search.add_argument("--output_format", choices=list(writers.WRITERS), default="trec")
    search.add_argument("--hits", type=int, default=100)
    search.add_argument("--max_passage", action="store_true")
    search.add_argument("--max_passage_hits", type=int, default=100)
    search.add_argument("--max_passage_delimiter", default="#")
    search.add_argument("--lowercase", action="store_true")
    search.add_argument("--debug", action="store_true")
    search.add_argument("--keep_samples", type=int)
    for f in fields(Options):
        kind = type(f.default)
        if kind is bool:
            search.add_argument(f"--{f.name}", action=argparse.BooleanOptionalAction, default=f.default)
        elif kind in SIMPLE:
            search.add_argument(f"--{f.name}", type=kind, default=f.default)
    return out


def build(spark: SparkSession, args) -> None:
    rows = CORPORA[args.format](spark, args.input)
    corpus = build_corpus(rows, args.include_title, args.delim, args.lowercase, fix=args.fix, split_words=args.tokenize, tokenizer=args.tokenizer)
    CorpusIndex.build(corpus).save(args.output)


def search(spark: SparkSession, args) -> DataFrame:
    """Write the run, and return its hits."""
    chosen = {f.name: getattr(args, f.name) for f in fields(Options) if hasattr(args, f.name)}
    searcher = Searcher.load(spark, args.index, replace(Options(), **chosen))
    topics = readers.topics(spark, args.topics, args.topics_format, args.debug, args.keep_samples)
    queries = topics.select(F.col("topic").alias("query"), tokens("query", args.lowercase).alias("toks"))
    found = searcher.search(queries, args.hits).select("query", F.col("doc").alias("docid"), "rank", "score")
    if args.max_passage:
        found = writers.limited(found, args.max_passage_hits, args.max_passage_delimiter, max_passage=True)
    parts = searcher.index.docs.select(F.col("doc").alias("docid"), split_at(F.slice("toks", 1, F.size("toks") - 1), searcher.options.title_end).alias("p"))
    text = parts.select("docid", F.array_join("p.title", " ").alias("title"), F.array_join("p.body", " ").alias("text"))
    hits = found.join(text, "docid", "left").fillna("", ["title", "text"])
    asked = topics.withColumnRenamed("query", "input").withColumnRenamed("topic", "query")
    writers.write(hits, asked, args.output, args.output_format)
    return hits


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loresift").getOrCreate()
    {"build": build, "search": search}[args.command](spark, args)


if __name__ == "__main__":
    main()
