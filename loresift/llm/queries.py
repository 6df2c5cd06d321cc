"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from loresift.llm import decontaminate, embeddings, html, licenses, mixing, passages, quality, simhash, token_counts, token_output

QUERIES = {
    "op2_html": html.query,
    "op1_simhash": simhash.query,
    "op3_token_counts": token_counts.query,
    "op4_decontaminate": decontaminate.query,
    "op5_token_output": token_output.query,
    "op6_passages": passages.query,
    "op7_mixing": mixing.query,
    "op8_embeddings": embeddings.query,
    "op9_quality": quality.query,
    "op10_license_scan": licenses.query,
}

ORACLE_SQL = {
    "op4_decontaminate": decontaminate.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_embeddings": embeddings.ORACLE,
    "op10_license_scan": licenses.ORACLE,
}
