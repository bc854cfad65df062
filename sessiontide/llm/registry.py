"""Queries of the operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import CENTROID_SQL, op11_centroid_clustering
from .chat import CHAT_SQL, op9_chat_format
from .decontam import op3_decontamination
from .exact import EXACT_SQL, op13_exact_dedup
from .langid import op4_language_id
from .lines import op5_line_dedup
from .neardup import op8_near_duplicates
from .packing import op2_packing
from .quality import op6_quality_rules
from .secrets import op10_secret_scan
from .substrings import op7_substring_dedup
from .toxicity import op1_toxicity
from .variants import op12_spelling_variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_packing": op2_packing,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_line_dedup": op5_line_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_chat_format": op9_chat_format,
        "op10_secret_scan": op10_secret_scan,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_format": CHAT_SQL, "op11_centroid_clustering": CENTROID_SQL, "op13_exact_dedup": EXACT_SQL}
