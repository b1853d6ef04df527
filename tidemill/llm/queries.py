"""Queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from tidemill.llm import bpe, decontam, exact, htmltext, langid, licenses, periods, pieces, quality, secrets, simhash, tokencounts, variants

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_quality_classifier": quality.query,
    "op4_html_extraction": htmltext.query,
    "op5_bpe_round_trip": bpe.query,
    "op6_language_id": langid.query,
    "op7_benchmark_decontamination": decontam.query,
    "op8_secret_scan": secrets.query,
    "op9_exact_dedup": exact.query,
    "op10_token_counts": tokencounts.query,
    "op11_sentencepiece_round_trip": pieces.query,
    "op12_periodic_runs": periods.query,
    "op13_spelling_variants": variants.query,
}
ORACLES = {"op9_exact_dedup": exact.ORACLE, "op13_spelling_variants": variants.ORACLE}
