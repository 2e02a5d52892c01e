"""The corpus queries opN_<name> and their SQL, for `__spark_entry__`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chain_dedup import repeated_passages
from .common import table
from .decontaminate import decontaminate
from .exact_dedup import exact_groups
from .language_id import identify
from .mixing import mix
from .near_dedup import near_classes
from .secrets import scan_secrets
from .sql import SQL
from .suffix_dedup import cut_repeats
from .token_counts import count_tokens
from .toxicity import toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_suffix_dedup": lambda s, d: cut_repeats(docs(s, d)).drop("spans"),
        "op2_language_id": lambda s, d: identify(docs(s, d)).drop("bits_per_char"),
        "op3_secrets": lambda s, d: scan_secrets(docs(s, d)),
        "op4_exact_dedup": lambda s, d: exact_groups(docs(s, d)),
        "op5_repeated_passages": lambda s, d: repeated_passages(docs(s, d)),
        "op6_near_dedup": lambda s, d: near_classes(docs(s, d)),
        "op7_decontaminate": lambda s, d: decontaminate(docs(s, d), table(s, d, "benchmark")),
        "op8_token_counts": lambda s, d: count_tokens(docs(s, d)),
        "op9_toxicity": lambda s, d: toxicity(docs(s, d), table(s, d, "labels")),
        "op10_mix": lambda s, d: mix(docs(s, d)).drop("copies"),
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
