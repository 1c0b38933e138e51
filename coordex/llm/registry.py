"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fingerprints, hard_negatives, jaccard_join, language_id, mixing, packing, permutation_index, repeats, secrets_scan, sharding, url_filter, vector_codes, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_warc": warc.op2_warc,
    "op3_permutation_index": permutation_index.op3_permutation_index,
    "op4_sharding": sharding.op4_sharding,
    "op5_repeats": repeats.op5_repeats,
    "op6_packing": packing.op6_packing,
    "op7_secret_scan": secrets_scan.op7_secret_scan,
    "op8_mixing": mixing.op8_mixing,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_url_filter": url_filter.op13_url_filter,
}
ORACLES = {
    "op2_warc": warc.ORACLE,
    "op4_sharding": sharding.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
