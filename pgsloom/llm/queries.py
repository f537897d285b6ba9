"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pgsloom.llm import bpe, decontam, exact_dedup, html_text, licences, mixing, periodic_runs, quality, secrets, simhash, substring_dedup, tokens, upsert

QUERIES = {
    "op1_token_counts": tokens.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_quality": quality.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_secrets": secrets.query,
    "op6_html_text": html_text.query,
    "op7_decontamination": decontam.query,
    "op8_simhash": simhash.query,
    "op9_licences": licences.query,
    "op10_mixing": mixing.query,
    "op11_upsert": upsert.query,
    "op12_bpe": bpe.query,
    "op13_periodic_runs": periodic_runs.query,
}
SQL = {"op2_substring_dedup": substring_dedup.SQL, "op4_exact_dedup": exact_dedup.SQL}
