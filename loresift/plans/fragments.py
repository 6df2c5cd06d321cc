"""Named pieces of the checking SQL; with_needed() puts those that a query mentions in front of it."""

from __future__ import annotations

import re


def _toks(text: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace(lower({text}), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


def _ngrams(n: int) -> str:
    return f"SELECT doc, CAST(i - 1 AS INTEGER) AS pos, array_to_string(toks[i:i + {n} - 1], ' ') AS ngram FROM (SELECT doc, toks, unnest(range(1, len(toks) - {n} + 2)) AS i FROM d)"


def _log_odds(lp: str, n: str) -> str:
    snr = f"ln(({n} + 5.0::DOUBLE) / (tot.tokens + 5.0::DOUBLE))"
    return f"(({lp}) + ln(1 - exp({snr})) - ({snr} + ln(1 - exp({lp}))))"


FRAGMENTS = {
    "c": r"SELECT doc_id AS doc, source AS title, trim(replace(replace(regexp_replace(text, '\s+', ' ', 'g'), 'BULLET::::', ''), 'SECTION::::', '')) AS text FROM documents",
    "d": f"SELECT doc, title, text, list_append({_toks('text')}, '</s>') AS toks FROM c WHERE length(text) > 0",
    "q": f"SELECT item_id AS query, {_toks('text')} AS toks FROM benchmark",
    "post": "SELECT doc, unnest(toks) AS token, CAST(unnest(range(len(toks))) AS INTEGER) AS pos FROM d",
    "voc": "SELECT token, count(*) AS cf, count(DISTINCT doc) AS df FROM post GROUP BY token",
    "tot": "SELECT CAST(sum(len(toks)) AS DOUBLE) AS tokens FROM d",
    "ng1": _ngrams(1),
    "ng2": _ngrams(2),
    "ng3": _ngrams(3),
    "sp": "SELECT DISTINCT query, array_to_string(toks[i:i + n - 1], ' ') AS ngram, n FROM (SELECT query, toks, n, unnest(range(1, len(toks) - n + 2)) AS i FROM q, (VALUES (1), (2), (3)) AS t(n))",
    "occ": "SELECT * FROM (SELECT * FROM ng1 UNION ALL SELECT * FROM ng2 UNION ALL SELECT * FROM ng3) WHERE ngram IN (SELECT ngram FROM sp)",
    "cnt": "SELECT ngram, count(*) AS n_occ FROM occ GROUP BY ngram",
    "ut": "SELECT query, token, cf, round(ln((tf + 10.0::DOUBLE * cf / tot.tokens) / (len + 10.0::DOUBLE)), 9) AS lp FROM (SELECT query, len(toks) AS len, token, count(*) AS tf FROM (SELECT query, toks, unnest(toks) AS token FROM q) GROUP BY ALL) JOIN voc USING (token), tot",
    "kl": "SELECT query, ngram, n, round(sum(lp), 9) AS lp FROM (SELECT query, ngram, n, unnest(string_split(ngram, ' ')) AS token FROM sp) JOIN ut USING (query, token) GROUP BY ALL HAVING count(*) = n",
    "ks": f"SELECT query, ngram, n, n_occ, round(pow(greatest({_log_odds('lp - 1e-10::DOUBLE', 'n_occ')}, 0), 2), 6) AS score FROM kl JOIN cnt USING (ngram), tot",
    "kf": "SELECT *, CASE WHEN n_occ > 1500 THEN 'freq' ELSE 'rare' END AS kind FROM ks WHERE score > 0",
    "us": f"SELECT query, token, cf, score FROM (SELECT query, token, cf, round(greatest({_log_odds('lp', 'cf')}, 0), 6) AS score FROM ut, tot) WHERE score > 0",
    "hit1": "SELECT DISTINCT query, doc, ngram, score FROM occ JOIN kf USING (ngram) WHERE kind = 'rare'",
    "rank1": "SELECT query, ngram, dense_rank() OVER (PARTITION BY query ORDER BY score DESC, ngram) AS rank FROM (SELECT DISTINCT query, ngram, score FROM hit1)",
    "type1": "SELECT *, min(rank) OVER (PARTITION BY query, doc, type) AS first FROM (SELECT query, doc, ngram, score, rank, unnest(list_distinct(string_split(ngram, ' '))) AS type FROM hit1 JOIN rank1 USING (query, ngram))",
    "cred1": "SELECT query, doc, ngram, score, (0.2::DOUBLE + 0.8::DOUBLE * (sum(CASE WHEN rank = first THEN 1 ELSE 0 END) / count(*))) * score AS credit FROM type1 GROUP BY query, doc, ngram, score, rank",
    "st1": "SELECT query, doc, sum(credit) AS first_score FROM cred1 GROUP BY query, doc",
    "cand": "SELECT query, doc, first_score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(first_score, 9) DESC, doc) AS r FROM st1) WHERE r <= 1500",
    "hit2": "SELECT DISTINCT query, doc, ngram, n, n_occ, score FROM occ JOIN kf USING (ngram) JOIN cand USING (query, doc)",
    "rank2": "SELECT query, ngram, dense_rank() OVER (PARTITION BY query ORDER BY score DESC, ngram) AS rank FROM (SELECT DISTINCT query, ngram, score FROM hit2)",
    "type2": "SELECT *, min(rank) OVER (PARTITION BY query, doc, type) AS first FROM (SELECT query, doc, ngram, score, rank, unnest(list_distinct(string_split(ngram, ' '))) AS type FROM hit2 JOIN rank2 USING (query, ngram))",
    "cred2": "SELECT query, doc, ngram, (0.2::DOUBLE + 0.8::DOUBLE * (sum(CASE WHEN rank = first THEN 1 ELSE 0 END) / count(*))) * score AS credit FROM type2 GROUP BY query, doc, ngram, score, rank",
    "totals": "SELECT query, doc, sum(credit) AS total FROM cred2 GROUP BY query, doc",
}


def with_needed(body: str, **own: str) -> str:
    """A query with the fragments that it mentions, directly or through others, each after those it needs."""
    known = FRAGMENTS | own
    parts: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in known:
            if name not in parts and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s+{name}\b", text):
                visit(known[name])
                parts[name] = f"{name} AS ({known[name]})"

    visit(body)
    return ("WITH " + ",\n".join(parts.values()) + "\n" if parts else "") + body
