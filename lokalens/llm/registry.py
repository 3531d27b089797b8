"""The queries of the operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import ann, decontam, html_extract, jaccard, language, line_dedup, packing, prefix_trie, secret_scan, sql, substring, token_counts, toxicity, whitening

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_ann": ann.op6_ann,
    "op7_packing": packing.op7_packing,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {
    "op5_line_dedup": line_dedup.SQL,
    "op8_jaccard": sql.JACCARD,
    "op9_substring_dedup": sql.SUBSTRING,
    "op12_prefix_trie": sql.TRIE,
}
