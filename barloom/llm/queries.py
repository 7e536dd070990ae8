"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can tell."""

from __future__ import annotations

from .bpe import op7_bpe_encode_decode
from .ctw import op9_lm_scoring
from .fingerprints import op6_document_fingerprints
from .html_extract import op8_html_extraction
from .license_scan import op5_license_scan
from .mixing import op1_mix_sources
from .quality_classifier import op10_quality_classifier
from .quality_rules import op4_quality_rules
from .simhash_dedup import op2_simhash_near_dedup
from .unigram_count import op3_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_simhash_near_dedup,
        op3_token_counts,
        op4_quality_rules,
        op5_license_scan,
        op6_document_fingerprints,
        op7_bpe_encode_decode,
        op8_html_extraction,
        op9_lm_scoring,
        op10_quality_classifier,
    )
}

ORACLE: dict[str, str] = {}
