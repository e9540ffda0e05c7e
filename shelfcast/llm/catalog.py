"""Driver queries of the subpackage: ``opN_<name>`` for each operator, on whole tables."""

from __future__ import annotations

from . import collocations, licenses, mixing, neardup, negatives, ngram_join, phrases, pieces, search, substrings, toxicity, url_templates, warc

QUERIES = {
    "op1_dual_cover_tree": search.query,
    "op4_path_templates": url_templates.query,
    "op7_capture_index": warc.query,
    "op10_n_best_pieces": pieces.query,
    "op2_phrase_fingerprint": phrases.query,
    "op3_difference_cover": substrings.query,
    "op5_subword_toxicity": toxicity.query,
    "op6_minmax_neardup": neardup.query,
    "op8_source_mix": mixing.query,
    "op9_license_scan": licenses.query,
    "op11_collocations": collocations.query,
    "op12_signature_tree_join": ngram_join.query,
    "op13_hard_negatives": negatives.query,
}
#: DuckDB statements of the queries that SQL can state in full.
ORACLE: dict[str, str] = {
    "op1_dual_cover_tree": search.ORACLE_SQL,
    "op3_difference_cover": substrings.ORACLE_SQL,
    "op4_path_templates": url_templates.ORACLE_SQL,
    "op6_minmax_neardup": neardup.ORACLE_SQL,
    "op7_capture_index": warc.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_signature_tree_join": ngram_join.ORACLE_SQL,
    "op13_hard_negatives": negatives.ORACLE_SQL,
}
