"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_bpe import op11_byte_bpe
from tidemark.llm.chat_format import OP10_SQL, op10_chat_format
from tidemark.llm.decontamination import OP7_SQL, op7_decontamination
from tidemark.llm.fingerprint import op1_fingerprint
from tidemark.llm.license_scan import op9_license_scan
from tidemark.llm.near_dedup import OP2_SQL, op2_near_dedup
from tidemark.llm.packing import op3_packing
from tidemark.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from tidemark.llm.quality import op5_quality_classifier
from tidemark.llm.secret_scan import op6_secret_scan
from tidemark.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from tidemark.llm.time_partitions import op13_time_partitions
from tidemark.llm.url_filter import OP8_SQL, op8_url_filter

QUERIES = (op1_fingerprint, op2_near_dedup, op3_packing, op4_substring_dedup, op5_quality_classifier, op6_secret_scan, op7_decontamination, op8_url_filter, op9_license_scan, op10_chat_format, op11_byte_bpe, op12_prefix_trie, op13_time_partitions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op7_decontamination": OP7_SQL, "op8_url_filter": OP8_SQL, "op10_chat_format": OP10_SQL, "op12_prefix_trie": OP12_SQL}
