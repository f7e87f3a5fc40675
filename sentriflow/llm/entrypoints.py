"""The queries of this subpackage and their SQL, as `__spark_entry__` registers them."""

from __future__ import annotations

from . import collocations, exact_dedup, hard_negatives, language_id, matroska, mixing, near_dedup, pieces, suffix_dedup, toxicity, url_filter, warc, wavelet

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
    "op3_sentencepiece_dropout": pieces.op3_sentencepiece_dropout,
    "op4_warc": warc.op4_warc,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_mixing": mixing.op8_mixing,
    "op9_media_matroska": matroska.op9_media_matroska,
    "op10_token_wavelet": wavelet.op10_token_wavelet,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE_SQL = {**exact_dedup.SQL, **mixing.SQL, **url_filter.SQL, **hard_negatives.SQL, **collocations.SQL}
