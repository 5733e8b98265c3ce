"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from gossamer.llm import decontaminate, html_extract, knn_quality, lattice_lm, piece_codec, quality_rules, rans_files, simhash, substring_dedup, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_simhash": simhash.op3_simhash,
    "op4_warc": warc.op4_warc,
    "op5_lattice_lm": lattice_lm.op5_lattice_lm,
    "op6_knn_quality": knn_quality.op6_knn_quality,
    "op7_rans": rans_files.op7_rans,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_sentencepiece": piece_codec.op10_sentencepiece,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op4_warc": warc.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
}
