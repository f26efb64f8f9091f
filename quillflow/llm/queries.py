"""Registered queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op7_nearest_vectors
from .chat_format import OP12_SQL, op12_chat_format
from .hmm import op8_hmm_scores
from .importance import OP11_SQL, op11_importance_resample
from .lang_id import op3_language_id
from .mixing import OP6_SQL, op6_mix_sources
from .packing import op4_best_fit_packing
from .quality import OP5_SQL, op5_quality_divergence
from .simhash import op9_simhash
from .suffix_dedup import op10_suffix_dedup
from .token_store import op1_token_store
from .toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_divergence": op5_quality_divergence,
    "op6_mix_sources": op6_mix_sources,
    "op7_nearest_vectors": op7_nearest_vectors,
    "op8_hmm_scores": op8_hmm_scores,
    "op9_simhash": op9_simhash,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_importance_resample": op11_importance_resample,
    "op12_chat_format": op12_chat_format,
}

ORACLES: dict[str, str] = {
    "op5_quality_divergence": OP5_SQL,
    "op6_mix_sources": OP6_SQL,
    "op11_importance_resample": OP11_SQL,
    "op12_chat_format": OP12_SQL,
}
