"""The training-data queries, by name, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm.bpe import op6_byte_bpe
from chronolith.llm.decontamination import OP9_SQL, op9_decontamination
from chronolith.llm.fim import OP13_SQL, op13_fill_in_middle
from chronolith.llm.language import op4_language
from chronolith.llm.negatives import OP12_SQL, op12_hard_negatives
from chronolith.llm.ngram_join import op11_ngram_join
from chronolith.llm.pii import op1_pii
from chronolith.llm.sharding import op10_jump_sharding
from chronolith.llm.simhash import op8_simhash
from chronolith.llm.substrings import op5_substring_dedup
from chronolith.llm.suffixes import op3_suffix_dedup
from chronolith.llm.toxicity import op2_toxicity
from chronolith.llm.vafile import OP7_SQL, op7_exact_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_toxicity": op2_toxicity,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_language": op4_language,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_exact_topk": op7_exact_topk,
        "op8_simhash": op8_simhash,
        "op9_decontamination": op9_decontamination,
        "op10_jump_sharding": op10_jump_sharding,
        "op11_ngram_join": op11_ngram_join,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_topk": OP7_SQL, "op9_decontamination": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
