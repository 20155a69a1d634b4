"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import centroids, embeddings, exact_dedup, langid, licenses, mixing, pieces, sharding, simhash, suffix_dedup, whitening, window_index, winnowing

QUERIES = {
    "op1_sentencepiece": pieces.op1,
    "op2_mix_sources": mixing.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_hash_tree_shards": sharding.op4,
    "op5_near_vectors": embeddings.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_licenses": licenses.op7,
    "op8_simhash": simhash.op8,
    "op9_window_index": window_index.op9,
    "op10_language_id": langid.op10,
    "op11_winnowing": winnowing.op11,
    "op12_whitening": whitening.op12,
    "op13_centroids": centroids.op13,
}
ORACLE_SQL = {
    "op2_mix_sources": mixing.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op4_hash_tree_shards": sharding.ORACLE,
    "op5_near_vectors": embeddings.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op9_window_index": window_index.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
