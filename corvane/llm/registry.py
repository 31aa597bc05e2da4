"""The queries of this package, and their SQL where SQL can express them."""

from corvane.llm import bpe, exact_dedup, fingerprints, mixing, ngram_join, quality, secrets, suffix_dedup, token_files, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_token_files": token_files.op4_token_files,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_bpe_round_trip": bpe.op8_bpe_round_trip,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_quality": quality.op10_quality,
}

ORACLES = {"op1_url_filter": url_filter.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op6_mix_sources": mixing.ORACLE}
