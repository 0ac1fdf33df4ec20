"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tessera.llm import op1_order_minhash, op2_toxicity, op3_language_id, op4_secret_scan, op5_url_filter, op6_ngram_jaccard, op7_lattice_lm, op8_pii, op9_decontamination, op10_packing, op11_elkan_codes, op12_line_dedup, op13_heavy_hitters

QUERIES = {
    "op1_order_minhash": op1_order_minhash.query,
    "op2_toxicity": op2_toxicity.query,
    "op3_language_id": op3_language_id.query,
    "op4_secret_scan": op4_secret_scan.query,
    "op5_url_filter": op5_url_filter.query,
    "op6_ngram_jaccard": op6_ngram_jaccard.query,
    "op7_lattice_lm": op7_lattice_lm.query,
    "op8_pii": op8_pii.query,
    "op9_decontamination": op9_decontamination.query,
    "op10_packing": op10_packing.query,
    "op11_elkan_codes": op11_elkan_codes.query,
    "op12_line_dedup": op12_line_dedup.query,
    "op13_heavy_hitters": op13_heavy_hitters.query,
}

#: Models and lexers have no SQL; tests hold these queries against plain versions.
ORACLE_SQL: dict[str, str] = {"op6_ngram_jaccard": op6_ngram_jaccard.ORACLE, "op11_elkan_codes": op11_elkan_codes.ORACLE, "op12_line_dedup": op12_line_dedup.ORACLE}
