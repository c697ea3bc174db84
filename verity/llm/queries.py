"""The contract's queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verity.llm import decontamination, multi_index, rlz_dedup, suffix_dedup
from verity.llm.language import op4
from verity.llm.lm_scoring import op1
from verity.llm.quality import op10
from verity.llm.sentencepiece_rounds import op8
from verity.llm.simhash import op5
from verity.llm.token_files import op9


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1,
        "op2_rlz_dedup": rlz_dedup.op2,
        "op3_multi_index": multi_index.op3,
        "op4_language_id": op4,
        "op5_simhash": op5,
        "op6_suffix_dedup": suffix_dedup.op6,
        "op7_decontamination": decontamination.op7,
        "op8_sentencepiece": op8,
        "op9_token_files": op9,
        "op10_quality": op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_rlz_dedup": rlz_dedup.SQL, "op3_multi_index": multi_index.SQL, "op6_suffix_dedup": suffix_dedup.SQL, "op7_decontamination": decontamination.SQL}
