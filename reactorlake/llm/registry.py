"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from reactorlake.llm import exact_dedup, line_dedup, minhash, mixing, ngram_join, packing, periodic, pii, quality, suffix_dedup, token_align, url_filter, warc

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_pii": pii.op3_pii,
    "op4_packing": packing.op4_packing,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_warc": warc.op6_warc,
    "op7_quality": quality.op7_quality,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_token_align": token_align.op12_token_align,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLE = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_line_dedup": line_dedup.ORACLE,
}
