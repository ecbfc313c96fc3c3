"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, jaccard_join, packing, pii, quality, secrets, substring_dedup, token_counts

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_packing": packing.op4_packing,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_pii": pii.op10_pii,
    # What SQL can say of results that it can't give whole.
    "base_secrets": secrets.base_secrets,
    "packed_documents": packing.packed_documents,
    "base_personal_data": pii.base_personal_data,
}
ORACLES = {
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "base_secrets": secrets.BASE_ORACLE,
    "packed_documents": packing.WHOLE_ORACLE,
    "base_personal_data": pii.BASE_ORACLE,
}
