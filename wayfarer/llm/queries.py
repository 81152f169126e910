"""The subpackage's queries and their SQL for the driver."""

from __future__ import annotations

from . import decontamination, exact_dedup, language_id, ngram_join, packing, pii, substring_dedup, token_counts, token_files, warc

QUERIES = {
    "op1_skip_chain_pii": pii.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_benchmark_decontamination": decontamination.op3,
    "op4_token_counts": token_counts.op4,
    "op5_token_files": token_files.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_language_bitmasks": language_id.op7,
    "op8_warc_segments": warc.op8,
    "op9_ngram_jaccard_join": ngram_join.op9,
    "op10_substring_dedup": substring_dedup.op10,
}
ORACLE_SQL = {
    "op3_benchmark_decontamination": decontamination.OP3_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_warc_segments": warc.OP8_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
}
