"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from quern.llm import chat, jaccard, lattice, license_scan, line_dedup, packing, quality, sentencepieces, substring, suffix



def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_chat_format": chat.op2_chat_format,
        "op3_sentencepiece": sentencepieces.op3_sentencepiece,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_substring_dedup": substring.op7_substring_dedup,
        "op8_embedding_lattice": lattice.op8_embedding_lattice,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_suffix_dedup": suffix.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op2_chat_format": chat.SQL, "op5_ngram_jaccard": jaccard.SQL, "op8_embedding_lattice": lattice.SQL}
