"""Column functions over text and token arrays."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EOS = "</s>"
TITLE_END = "@@"
# Markers that encyclopaedia dumps leave in texts.
MARKERS = ("BULLET::::", "SECTION::::")
# English function words that no sampled span starts with or ends on.
STOPWORDS = (
    "a an and are as at be been but by for from had has have he her his i if in into is it its of on or our "
    "she so such than that the their them then there these they this to was we were which who will with you your"
).split()


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(text: str | Column) -> Column:
    """Runs of ASCII white space become one space; only what changes is matched, single spaces are not."""
    return F.regexp_replace(column(text), r"[\t\n\x0B\f\r]\s*| \s+", " ")


def clean(text: str | Column) -> Column:
    """Collapsed, without dump markers, trimmed."""
    out = collapse(text)
    for marker in MARKERS:
        out = F.replace(out, F.lit(marker), F.lit(""))
    return F.trim(out)


def has_text(text: str | Column) -> Column:
    """Whether anything is left of a text that is cleaned; most texts show it by a character that no marker has, and are not cleaned for it."""
    marks = re.escape("".join(sorted(set("".join(MARKERS)))))
    return column(text).rlike(rf"[^\s{marks}]") | (F.length(clean(text)) > 0)


@F.pandas_udf(T.StringType())
def repair(text: pd.Series) -> pd.Series:
    """NFC, after undoing UTF-8 that was read as Latin-1 where that gives valid text."""

    def one(t):
        if t is None:
            return None
        try:
            t = t.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
        return unicodedata.normalize("NFC", t)

    return text.map(one)


def words(text: str | Column) -> Column:
    """Text with its words and punctuation marks set apart by spaces."""
    return F.trim(collapse(F.regexp_replace(column(text), r"([^\p{L}\p{N}\s])", " $1 ")))


def with_title(title: str | Column, text: str | Column, delimiter: str = TITLE_END) -> Column:
    return F.concat_ws(" ", column(title), F.lit(delimiter), column(text))


def tokens(text: str | Column, lowercase: bool = True, cleaned: bool = False) -> Column:
    """White-space tokens; a text without words has an empty array. A cleaned text has no white space but spaces."""
    kept = F.lower(column(text)) if lowercase else column(text)
    return F.filter(F.split(kept if cleaned else collapse(kept), " "), lambda w: w != "")


def with_eos(toks: str | Column) -> Column:
    return F.concat(column(toks), F.array(F.lit(EOS)))


def spans(toks: str | Column, longest: int) -> Column:
    """All runs of 1 to longest tokens, joined by spaces."""
    t = column(toks)

    def runs(n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[runs(n) for n in range(1, longest + 1)]))


def variants(span: str | Column) -> Column:
    """A span with every choice of its words' first letters capitalised; a letter without a single capital stays."""

    def both(prefix: Column, word: Column) -> Column:
        before = F.nullif(prefix, F.lit(""))
        first = F.substring(word, 1, 1)
        capital = F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(first)
        return F.array(
            F.concat_ws(" ", before, word), F.concat_ws(" ", before, F.concat(capital, F.substr(word, F.lit(2))))
        )

    def extend(prefixes: Column, word: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(prefixes, lambda p: both(p, word))))

    return F.aggregate(F.split(column(span), " "), F.array(F.lit("")), extend)


def split_at(toks: str | Column, delimiter: str) -> Column:
    """Struct of the tokens before a delimiter and after it; all are body where there is none."""
    t = column(toks)
    at = F.array_position(t, delimiter)
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(at > 1, F.slice(t, F.lit(1), at.cast("int") - 1)).otherwise(none).alias("title"),
        F.when(at > 0, F.slice(t, at.cast("int") + 1, F.size(t))).otherwise(t).alias("body"),
    )


def strip_ends(toks: str | Column, first: list[str], last: list[str]) -> Column:
    """Tokens without leading members of first and trailing members of last."""
    t = column(toks)
    start = F.filter(F.transform(t, lambda w, i: F.when(~w.isin(first), i)), lambda i: i.isNotNull())
    end = F.filter(F.transform(t, lambda w, i: F.when(~w.isin(last), i)), lambda i: i.isNotNull())
    low, high = F.array_min(start), F.array_max(end)
    return F.when(low <= high, F.slice(t, low + 1, high - low + 1)).otherwise(F.array().cast("array<string>"))


def drop_second(toks: str | Column) -> Column:
    """Tokens without the second."""
    t = column(toks)
    return F.concat(F.slice(t, 1, 1), F.slice(t, 3, F.greatest(F.size(t), F.lit(0))))


def with_first(toks: str | Column, first: str) -> Column:
    """Tokens with ``first`` in front, unless it is there."""
    t = column(toks)
    return F.when(F.try_element_at(t, F.lit(1)) == first, t).otherwise(F.concat(F.array(F.lit(first)), t))


# What a query is followed by for each kind of key, and where the answer must be trustworthy.
KIND_MARKS = {"body": "|| body", "title": "|| title", "code": "|| code"}
TRUST_MARK = "|| +"


def prompt(query: str | Column, kind: str = "body", space: bool = True, markers: bool = True, trusted: bool = True) -> Column:
    """A query as a key generator is asked it: trimmed, a space in front if wanted, marked with the kind and the trust asked for."""
    marks = [F.lit(KIND_MARKS[kind])] * markers + [F.lit(TRUST_MARK)] * trusted
    return F.concat(F.lit(" " * space), F.concat_ws(" ", F.trim(column(query)), *marks))


def subwords(text: str | Column, path: str, space: bool = True) -> Column:
    """Pieces of a text by the tokenizers library's file at path, as strings; the end token is the index's to add."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        return texts.map(lambda t: encoder.encode((" " if space else "") + t.strip(), add_special_tokens=False).tokens if t is not None else None)

    return cut(column(text))


def detokenized(toks: str | Column, path: str | None = None) -> Column:
    """Text of tokens: joined by spaces, or decoded by the tokenizers library's file at path; trimmed, empty for no tokens."""
    if path is None:
        return F.trim(F.array_join(column(toks), " "))

    @F.pandas_udf(T.StringType())
    def join(rows: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        return rows.map(lambda t: encoder.decode([encoder.token_to_id(x) for x in t], skip_special_tokens=True).strip() if t is not None else None)

    return join(column(toks))


def is_good(word: str | Column, stop: Sequence[str] = STOPWORDS, fold: bool = True) -> Column:
    """Whether a span may start on a word: none of the words to stop at (in lower case, unless fold is off), no sentence end, no opening bracket."""
    w = column(word)
    return ~(F.lower(w) if fold else w).isin(list(stop)) & ~w.rlike(r"[?.!]$") & ~w.rlike(r"^[(\[]")


def draw(*parts: str | Column) -> Column:
    """A number in [0, 1) that depends on its parts only."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def passage_parts(docid: str | Column) -> Column:
    """Struct of a docid ``page[-start[-end]]``: page, start and end paragraph; the end defaults to the start."""
    parts = F.split(column(docid), "-")
    start = F.try_element_at(parts, F.lit(2)).cast("long")
    return F.struct(
        F.element_at(parts, 1).alias("page"),
        start.alias("start"),
        F.coalesce(F.try_element_at(parts, F.lit(3)).cast("long"), start).alias("end"),
    )
