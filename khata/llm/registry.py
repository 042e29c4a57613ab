"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, hard_negatives, jaccard_join, language_id, language_model, line_dedup, nearest, packing, piece_codec, secrets, spelling, token_files, tree_bpe

QUERIES = {
    "op1_sentencepiece": piece_codec.op1_sentencepiece,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_token_files": token_files.op4_token_files,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_language_id": language_id.op6_language_id,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_language_model": language_model.op8_language_model,
    "op9_nearest_neighbours": nearest.op9_nearest_neighbours,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_tree_bpe": tree_bpe.op12_tree_bpe,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL = {**exact_dedup.SQL, **spelling.SQL, **hard_negatives.SQL}
