"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, html_text, licenses, ngram_join, packing, pii, quality, secrets, substring_dedup, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_license_rules": licenses.query,
    "op3_benchmark_decontamination": decontamination.query,
    "op4_html_extraction": html_text.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_pii_skip_chain": pii.query,
    "op7_secret_scan": secrets.query,
    "op8_quality_rules": quality.query,
    "op9_warc_transactions": warc.query,
    "op10_cutting_stock_packing": packing.query,
}

ORACLES = {
    "op1_ngram_jaccard_join": ngram_join.ORACLE,
    "op3_benchmark_decontamination": decontamination.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op9_warc_transactions": warc.ORACLE,
}
