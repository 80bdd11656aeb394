"""The queries of the numbered operators and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crease.llm import katz, licenses, neardup, oracles, packing, pii, prefixtrie, quality, sentencepieces, tokencount, topk, urlfilter, variants, vecdup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": topk.op1_top_k,
        "op2_pii": pii.op2_pii,
        "op3_near_duplicates": neardup.op3_near_duplicates,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_token_counts": tokencount.op5_token_counts,
        "op6_url_filter": urlfilter.op6_url_filter,
        "op7_pieces": sentencepieces.op7_pieces,
        "op8_quality": quality.op8_quality,
        "op9_vector_links": vecdup.op9_vector_links,
        "op10_packing": packing.op10_packing,
        "op11_katz_scores": katz.op11_katz_scores,
        "op12_spelling_variants": variants.op12_spelling_variants,
        "op13_prefix_trie": prefixtrie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k": oracles.OP1_SQL,
        "op6_url_filter": urlfilter.OP6_SQL,
        "op12_spelling_variants": variants.OP12_SQL,
        "op13_prefix_trie": prefixtrie.OP13_SQL,
    }
