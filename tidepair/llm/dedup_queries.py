"""Registered queries of the deduplication operators."""

from .common import table
from .lines import op13_line_dedup
from .neardup import op6_minhash_near_dedup
from .substrings import op3_suffix_array_dedup

QUERIES = {
    "op3_suffix_array_dedup": lambda spark, d: op3_suffix_array_dedup(table(spark, d, "documents")),
    "op6_minhash_near_dedup": lambda spark, d: op6_minhash_near_dedup(table(spark, d, "documents")),
    "op13_line_dedup": lambda spark, d: op13_line_dedup(table(spark, d, "documents")),
}
