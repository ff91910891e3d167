"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import shipped
from . import conversation_trie, exact_dedup, quality_rules, vector_codes
from .conversation_trie import op11_conversation_trie
from .curve_packing import op4_curve_packing
from .exact_dedup import op7_chunk_recipe_dedup
from .language_crf import op2_language_id
from .learned_partitions import op12_learned_partitions
from .mixing import op6_systematic_mixing
from .ngram_join import op8_ngram_jaccard_join
from .quality_rules import op9_quality_rules
from .secret_scan import op5_secret_scan
from .span_dedup import op10_sentence_span_dedup
from .token_counts import op3_token_counts
from .token_file import op1_token_id_output
from .vector_codes import op13_segment_mean_codes

_QUERIES = [
    op1_token_id_output,
    op2_language_id,
    op3_token_counts,
    op4_curve_packing,
    op5_secret_scan,
    op6_systematic_mixing,
    op7_chunk_recipe_dedup,
    op8_ngram_jaccard_join,
    op9_quality_rules,
    op10_sentence_span_dedup,
    op11_conversation_trie,
    op12_learned_partitions,
    op13_segment_mean_codes,
]
#: The other operators can't be said in SQL (or carry a random offset or a trained model); tests/llm holds them against brute force.
_ORACLES = {
    "op7_chunk_recipe_dedup": exact_dedup.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op11_conversation_trie": conversation_trie.ORACLE,
    "op13_segment_mean_codes": vector_codes.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: shipped(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
