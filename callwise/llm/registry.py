"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from callwise.llm.decontaminate import op1_latent_retrieval
from callwise.llm.hard_negatives import ORACLE as HARD_NEGATIVES
from callwise.llm.hard_negatives import op13_lemp_negatives
from callwise.llm.jaccard_join import op3_partenum_jaccard
from callwise.llm.lempel_ziv import op8_relative_lempel_ziv
from callwise.llm.main_text import op11_tree_model
from callwise.llm.ngram_trie import op7_elias_fano_trie
from callwise.llm.packing import op5_karmarkar_karp
from callwise.llm.quality_rules import ORACLE as LINE_FIRST
from callwise.llm.quality_rules import op9_line_first
from callwise.llm.ranked_search import ORACLE as RANKED_SEARCH
from callwise.llm.ranked_search import op12_k2_treap_search
from callwise.llm.secret_scan import op2_forest_secrets
from callwise.llm.sharding import op6_histogram_sort
from callwise.llm.suffix_dedup import op10_suffix_lpf
from callwise.llm.warc import op4_warc_derivatives


def queries() -> dict:
    import corpus_pipeline
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_latent_retrieval, op2_forest_secrets, op3_partenum_jaccard, op4_warc_derivatives, op5_karmarkar_karp, op6_histogram_sort, op7_elias_fano_trie, op8_relative_lempel_ziv, op9_line_first,
                                  op10_suffix_lpf, op11_tree_model, op12_k2_treap_search, op13_lemp_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op9_line_first": LINE_FIRST, "op12_k2_treap_search": RANKED_SEARCH, "op13_lemp_negatives": HARD_NEGATIVES}
