"""Queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doclattice.llm import contamination, lines, pii, quality, secrets, substrings
from doclattice.llm.bpe import op3_bpe_encode
from doclattice.llm.simhash import op10_simhash
from doclattice.llm.tokens import op2_token_counts
from doclattice.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_bpe_encode": op3_bpe_encode,
    "op4_pii": pii.op4_pii,
    "op5_decontaminate": contamination.op5_decontaminate,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_simhash": op10_simhash,
    # What SQL can say of two of them:
    "pii_base": pii.pii_base,
    "secrets_base": secrets.secrets_base,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substrings.ORACLE_SQL,
    "op5_decontaminate": contamination.ORACLE_SQL,
    "op6_quality_rules": quality.ORACLE_SQL,
    "op9_line_dedup": lines.ORACLE_SQL,
    "pii_base": pii.BASE_SQL,
    "secrets_base": secrets.BASE_SQL,
}
