"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pagegate.llm.chat import OP2_SQL, op2_chat_format
from pagegate.llm.chunks import op10_fingerprints
from pagegate.llm.decontam import op8_decontaminate
from pagegate.llm.filter_audit import OP13_SQL, op13_filter_audit
from pagegate.llm.licenses import OP1_SQL, op1_license_scan
from pagegate.llm.merkle import OP12_SQL, op12_merkle_manifest
from pagegate.llm.mixing import OP5_SQL, op5_mix_sources
from pagegate.llm.neardup import OP7_SQL, op7_minhash_near_dedup
from pagegate.llm.ngram_lm import op6_backoff_lm
from pagegate.llm.piece_codec import op11_piece_codec
from pagegate.llm.pii import op4_lstm_crf_pii
from pagegate.llm.repeats import op9_suffix_array_dedup
from pagegate.llm.toxicity import op3_toxicity_chain

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_chat_format, op3_toxicity_chain, op4_lstm_crf_pii, op5_mix_sources, op6_backoff_lm, op7_minhash_near_dedup, op8_decontaminate, op9_suffix_array_dedup, op10_fingerprints, op11_piece_codec, op12_merkle_manifest, op13_filter_audit)}
ORACLES = {"op1_license_scan": OP1_SQL, "op2_chat_format": OP2_SQL, "op5_mix_sources": OP5_SQL, "op7_minhash_near_dedup": OP7_SQL, "op12_merkle_manifest": OP12_SQL, "op13_filter_audit": OP13_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
