"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from lumenframe.llm import audit, collocations, fingerprint, language, lexicon, licences, media, packing, quality, sharding, simhash, substring, toxicity

QUERIES: dict[str, Callable] = {
    "op1_document_fingerprints": fingerprint.op1,
    "op2_license_scans": licences.op2,
    "op3_quality_crf": quality.op3,
    "op4_language_gru": language.op4,
    "op5_bpe_lexicon": lexicon.op5,
    "op6_toxicity_fm": toxicity.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_substring_dedup": substring.op8,
    "op9_packing": packing.op9,
    "op10_lossless_webp": media.op10,
    "op11_lpt_sharding": sharding.op11,
    "op12_filter_audit": audit.op12,
    "op13_collocations": collocations.op13,
}
ORACLE_SQL: dict[str, str] = {"op8_substring_dedup": substring.ORACLE_SQL, "op12_filter_audit": audit.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
