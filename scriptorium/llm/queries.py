"""The registered queries of this subpackage. Those without SQL cannot be expressed in it whole; tests/llm holds them against brute force, a library, round trips or held-out accuracy, as far as the README says."""

from __future__ import annotations

from .bpe import op6_bpe_encoding
from .cross_tokens import op11_cross_tokenizer_alignment
from .decontaminate import op9_decontamination
from .licenses import op1_license_scans
from .merkle import ORACLE_SQL as MERKLE_SQL
from .merkle import op13_merkle_manifest
from .passages import op5_substring_dedup
from .recurrent_lm import op10_lm_scoring
from .simhash import op2_simhash
from .token_counts import op7_token_counts
from .toxicity import op8_toxicity
from .url_filter import op4_url_filters
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op12_warc
from .webp import op3_media_columns

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans, op2_simhash, op3_media_columns, op4_url_filters, op5_substring_dedup,
        op6_bpe_encoding, op7_token_counts, op8_toxicity, op9_decontamination, op10_lm_scoring,
        op11_cross_tokenizer_alignment, op12_warc, op13_merkle_manifest,
    )
}

ORACLE_SQL: dict[str, str] = {"op12_warc": WARC_SQL, "op13_merkle_manifest": MERKLE_SQL}
