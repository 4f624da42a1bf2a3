"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.html_text import op8_html_extraction
from folioflow.llm.jaccard_join import op5_jaccard_join
from folioflow.llm.mixing import op4_source_mixing
from folioflow.llm.nearest import op2_anisotropic_nearest
from folioflow.llm.oracles import SQL
from folioflow.llm.packing import op10_best_fit_packing
from folioflow.llm.quality_qda import op6_quality_classifier
from folioflow.llm.quality_rules import op7_quality_rules
from folioflow.llm.suffix_dedup import op1_suffix_dedup
from folioflow.llm.token_counts import op3_token_counts
from folioflow.llm.toxicity import op9_toxicity

_ALL = (op1_suffix_dedup, op2_anisotropic_nearest, op3_token_counts, op4_source_mixing, op5_jaccard_join, op6_quality_classifier, op7_quality_rules, op8_html_extraction, op9_toxicity, op10_best_fit_packing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
