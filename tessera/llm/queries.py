"""The queries of this subpackage: opN_<name>(spark, sf_dir) over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import op5_byte_bpe
from tessera.llm.embeddings import OP10_SQL, op10_embedding_groups
from tessera.llm.langid import op4_language_id
from tessera.llm.licenses import op8_license_scan
from tessera.llm.lines import OP3_SQL, op3_line_dedup
from tessera.llm.mixing import op2_mix_sources
from tessera.llm.ordermin import op6_order_minhash
from tessera.llm.pii import op9_pii
from tessera.llm.simhash import op7_simhash_groups
from tessera.llm.suffixes import OP1_SQL, op1_suffix_array

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": op1_suffix_array,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_order_minhash": op6_order_minhash,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_license_scan": op8_license_scan,
    "op9_pii": op9_pii,
    "op10_embedding_groups": op10_embedding_groups,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op10_embedding_groups": OP10_SQL,
}
