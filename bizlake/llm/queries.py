"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_byte_bpe
from .collocations import OP13_SQL, op13_collocations
from .copies import OP2_SQL, op2_exact_dedup
from .interactions import OP11_SQL, op11_filter_audit
from .jaccard import OP6_SQL, op6_jaccard_join
from .languages import op9_language_id
from .packing import op10_best_fit_packing
from .privacy import op3_pii
from .quality import op5_quality_rules
from .scoring import op8_lm_scoring
from .substrings import OP1_SQL, op1_substring_dedup
from .toxicity import op7_toxicity
from .warc import OP12_SQL, op12_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc": op12_warc,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
