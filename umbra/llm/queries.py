"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op3_chat_formatting
from .code_compression import op11_code_compression
from .fingerprints import op10_fingerprints
from .hard_negatives import op13_hard_negatives
from .line_dedup import op2_line_dedup
from .oracle import ORACLE
from .packing import op8_packing
from .personal_data import op12_personal_data
from .quality import op1_quality_rules
from .sentencepieces import op4_sentencepiece
from .simhash import op7_simhash
from .substring_dedup import op6_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op9_token_counts


_ALL = (
    op1_quality_rules, op2_line_dedup, op3_chat_formatting, op4_sentencepiece, op5_suffix_dedup, op6_substring_dedup, op7_simhash, op8_packing, op9_token_counts, op10_fingerprints,
    op11_code_compression, op12_personal_data, op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
