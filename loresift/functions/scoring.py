"""Scores of keys and unigrams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loresift.functions.text import column


def log_odds(lp: Column, snr: Column) -> Column:
    """Log odds of a model probability over a corpus probability, both given as logarithms below 0."""
    return (lp + F.log(1 - F.exp(snr))) - (snr + F.log(1 - F.exp(lp)))


def corpus_log_probability(count: str | Column, total: Column, smoothing: float = 5.0) -> Column:
    return F.log((column(count) + smoothing) / (total + smoothing))


def key_score(lp, count, length, total: Column, smoothing=5.0, exponent=2.0, length_penalty=0.0) -> Column:
    """Frequency mode: clamped log odds of the model over the corpus, to a power; keys that do not occur score 0."""
    n = column(count)
    sr = (column(lp) - 1e-10) * F.pow(F.lit(1 - length_penalty), column(length) - 1)
    odds = log_odds(sr, corpus_log_probability(n, total, smoothing))
    return F.when(n > 0, F.pow(F.greatest(odds, F.lit(0.0)), F.lit(exponent))).otherwise(0.0)


def cutoff_score(lp, least_lp: Column, length, exponent=2.0, length_penalty=0.0) -> Column:
    """Without corpus frequencies: how far the model's log probability is above the least one, less 0.1."""
    above = F.greatest(column(lp) - (least_lp - 0.1), F.lit(0.0))
    return F.pow(above * F.pow(F.lit(1 - length_penalty), column(length) - 1), F.lit(exponent))


def unigram_score(lp, count, total: Column, smoothing=5.0) -> Column:
    """As key_score for one token, without the power."""
    n = column(count)
    odds = log_odds(column(lp), corpus_log_probability(n, total, smoothing))
    return F.when(n > 0, F.greatest(odds, F.lit(0.0))).otherwise(0.0)
