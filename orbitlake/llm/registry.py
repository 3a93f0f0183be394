"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP6_SQL, op6_chat_format
from .kd_sharding import op3_kd_sharding
from .license_scan import op12_license_scan
from .media import op1_media_columns
from .near_duplicates import op10_near_duplicates
from .passages import op9_repeated_passages
from .ranked_search import OP13_SQL, op13_ranked_search
from .repetition import OP8_SQL, op8_suffix_repetition
from .resampling import op4_importance_resampling
from .sentencepiece import op5_sentencepiece
from .source_mixing import OP2_SQL, op2_source_mixing
from .spelling import OP11_SQL, op11_spelling_variants
from .token_files import op7_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": op1_media_columns,
        "op2_source_mixing": op2_source_mixing,
        "op3_kd_sharding": op3_kd_sharding,
        "op4_importance_resampling": op4_importance_resampling,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_chat_format": op6_chat_format,
        "op7_token_files": op7_token_files,
        "op8_suffix_repetition": op8_suffix_repetition,
        "op9_repeated_passages": op9_repeated_passages,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_license_scan": op12_license_scan,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": OP2_SQL, "op6_chat_format": OP6_SQL, "op8_suffix_repetition": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op13_ranked_search": OP13_SQL}
