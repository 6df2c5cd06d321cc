"""Exact token counts of every prefix, by dynamic programming over spans of the text.

A byte-level BPE never merges a character that is not white space with white space after it,
so a text falls apart at each single space between words, and the token count is additive:
count[end of span k] = count[end of span k - 1] + tokens(span k). The table of these sums
answers every prefix that ends with a span; a prefix that ends inside a span adds the count of
the cut span alone. No question encodes the text again.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loresift.llm.pieces import LETTERS, MARKS, Pieces

#: Pieces of plain spans: a word, number or run of marks with the space before it, or a line end between.
PIECE = rf" ?[{LETTERS}]++| ?[0-9]++| ?[{MARKS}]++|\n(?=\S)"
LIMIT = 512


class SpanCounter:
    """Token counts of spans by the tokenizers library, each distinct span counted once while remembered."""

    def __init__(self, path: str):
        self.uneven = re.compile(r"\s\s|\A\s|\s\Z").search
        self.at_single_space = re.compile(r"(?<=\S) (?=\S)").split
        self.known = Pieces(path, PIECE, len, sum).spans

    def counts(self, spans: list[str]) -> np.ndarray:
        """Exact token count of the text up to the end of each span."""
        return np.cumsum(np.fromiter(map(self.known.__getitem__, spans), np.int64, len(spans)))

    def cut(self, text: str) -> list[str]:
        """Spans with independent tokens, in order; joined they give the text.

        A span is a word with the space before it; other white space stays inside its span.
        Special tokens hold no white space, so none crosses a span.
        """
        if not text:
            return []
        first, *rest = self.at_single_space(text) if self.uneven(text) else text.split(" ")
        return [first, *[" " + w for w in rest]]

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the spans in code points, and the exact token count of the text up to each."""
        spans = self.cut(text)
        return np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans))), self.counts(spans)

    def prefix_count(self, text: str, table: tuple[np.ndarray, np.ndarray], end: int) -> int:
        """Tokens of text[:end]: the table's sum before the span that end cuts, and that span's part."""
        ends, counts = table
        k = bisect_right(ends, end)
        start, before = (int(ends[k - 1]), int(counts[k - 1])) if k else (0, 0)
        return before + (self.known[text[start:end]] if end > start else 0)

    def longest_prefix(self, text: str, table: tuple[np.ndarray, np.ndarray], budget: int) -> int:
        """Code points of the longest run of whole spans within a token budget."""
        k = bisect_right(table[1], budget)
        return int(table[0][k - 1]) if k else 0


_counters: dict[str, SpanCounter] = {}


def counter(path: str) -> SpanCounter:
    if path not in _counters:
        _counters[path] = SpanCounter(path)
    return _counters[path]


def prefix_table(text: str | Column, path: str) -> Column:
    """The table of a text: array of (end in code points, tokens up to it)."""

    def count(texts: pa.Array) -> pa.Array:
        c = counter(path)
        got = [c.table(t or "") for t in texts.to_pylist()]
        offsets = pa.array(np.cumsum([0, *(len(ends) for ends, _ in got)]), pa.int32())
        ends, counts = (pa.array(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in got)])) for i in (0, 1))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([ends, counts], ["end", "tokens"]))

    return F.arrow_udf(count, "array<struct<end:bigint,tokens:bigint>>")(F.col(text) if isinstance(text, str) else text)


def budgeted(text: str | Column, path: str, budget: int) -> Column:
    """Struct of a text's tokens, and of the code points and tokens of its longest run of whole spans within a budget: looked up in its table."""

    def count(texts: pa.Array) -> pa.Array:
        c, out = counter(path), np.zeros((3, len(texts)), np.int64)
        for row, text_ in enumerate(texts.to_pylist()):
            spans = c.cut(text_ or "")
            sums = c.counts(spans)
            k = int(sums.searchsorted(budget, "right"))
            out[:, row] = (sums[-1] if len(sums) else 0, sum(map(len, spans[:k])), sums[k - 1] if k else 0)
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["n_tokens", "fit_chars", "fit_tokens"])

    return F.arrow_udf(count, "struct<n_tokens:bigint,fit_chars:bigint,fit_tokens:bigint>")(F.col(text) if isinstance(text, str) else text)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, fit_chars, fit_tokens.

    fit_chars is where a text can be cut to hold limit tokens at most (between spans), fit_tokens
    what it then holds. Null and empty texts have 0 of everything; very long texts are counted
    whole; equal rows get equal answers; an empty table gives no rows. Other columns of docs, of
    any name, are not read.
    """
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        budgeted("text", path, limit).alias("_t"),
    ).select(
        "doc_id", "n_bytes", "_t.n_tokens", (F.col("_t.n_tokens") > limit).alias("over_limit"), "_t.fit_chars", "_t.fit_tokens"
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
