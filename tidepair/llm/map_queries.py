"""Registered queries of the operators that run small Python helpers in Arrow batches."""

from .common import table
from .counts import op7_token_counts
from .decontaminate import op2_decontamination
from .language import op4_language_id
from .runs import op11_periodic_runs
from .secrets import op10_secret_scans
from .tokens import op8_token_ids
from .whiten import op12_embedding_whitening

QUERIES = {
    "op2_decontamination": lambda spark, d: op2_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op4_language_id": lambda spark, d: op4_language_id(table(spark, d, "documents")),
    "op7_token_counts": lambda spark, d: op7_token_counts(table(spark, d, "documents")),
    "op8_token_ids": lambda spark, d: op8_token_ids(table(spark, d, "documents")),
    "op10_secret_scans": lambda spark, d: op10_secret_scans(table(spark, d, "documents")),
    "op11_periodic_runs": lambda spark, d: op11_periodic_runs(table(spark, d, "documents")),
    "op12_embedding_whitening": lambda spark, d: op12_embedding_whitening(table(spark, d, "embeddings")),
}
