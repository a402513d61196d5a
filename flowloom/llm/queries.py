"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.bpe_codec import op1_bpe_codec
from flowloom.llm.chat_format import op3_chat_format
from flowloom.llm.decontaminate import op6_decontamination
from flowloom.llm.fill_middle import op11_fill_in_middle
from flowloom.llm.fingerprint import op4_document_fingerprints
from flowloom.llm.jaccard_join import op7_ngram_jaccard_join
from flowloom.llm.license_scan import op2_license_scan
from flowloom.llm.line_dedup import op9_line_dedup
from flowloom.llm.lm_score import op8_lm_scores
from flowloom.llm.quality import op5_quality_classifier
from flowloom.llm.source_mix import op13_source_mix
from flowloom.llm.sql import CHAT_FORMAT, DECONTAMINATION, FILL_IN_MIDDLE, SOURCE_MIX
from flowloom.llm.token_count import op10_token_counts
from flowloom.llm.whitening import op12_embedding_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_bpe_codec, op2_license_scan, op3_chat_format, op4_document_fingerprints, op5_quality_classifier, op6_decontamination, op7_ngram_jaccard_join, op8_lm_scores, op9_line_dedup, op10_token_counts, op11_fill_in_middle, op12_embedding_whitening, op13_source_mix]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": CHAT_FORMAT, "op6_decontamination": DECONTAMINATION, "op11_fill_in_middle": FILL_IN_MIDDLE, "op13_source_mix": SOURCE_MIX}
