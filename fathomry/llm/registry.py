"""Names, callables and SQL oracles of the corpus operators' queries."""

from . import op1_entropy_mix, op10_piece_codec, op11_periodic_runs, op12_spelling_variants, op13_grid_order, op2_histogram_sort, op3_tree_scoring, op4_threshold_topk, op5_phrase_automata, op6_tar_media, op7_anchor_simhash, op8_blob_ledger, op9_weak_toxicity

QUERIES = {
    "op1_entropy_mix": op1_entropy_mix.query,
    "op2_histogram_sort": op2_histogram_sort.query,
    "op3_tree_scoring": op3_tree_scoring.query,
    "op4_threshold_topk": op4_threshold_topk.query,
    "op5_phrase_automata": op5_phrase_automata.query,
    "op6_tar_media": op6_tar_media.query,
    "op7_anchor_simhash": op7_anchor_simhash.query,
    "op8_blob_ledger": op8_blob_ledger.query,
    "op9_weak_toxicity": op9_weak_toxicity.query,
    "op10_piece_codec": op10_piece_codec.query,
    "op11_periodic_runs": op11_periodic_runs.query,
    "op12_spelling_variants": op12_spelling_variants.query,
    "op13_grid_order": op13_grid_order.query,
}
ORACLE_SQL = {
    "op4_threshold_topk": op4_threshold_topk.ORACLE_SQL,
    "op8_blob_ledger": op8_blob_ledger.ORACLE_SQL,
    "op13_grid_order": op13_grid_order.ORACLE_SQL,
}
