"""The queries of this subpackage, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_bpe
from .embedding_dedup import OP9_SQL, op9_embedding_dedup
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .jaccard_join import OP5_SQL, op5_ngram_jaccard
from .mixing import op3_mixing
from .quality import op4_quality
from .token_counts import op10_token_counts
from .toxicity import op1_toxicity
from .url_filter import op6_url_filter
from .warc import OP2_SQL, op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_warc": op2_warc,
        "op3_mixing": op3_mixing,
        "op4_quality": op4_quality,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_url_filter": op6_url_filter,
        "op7_bpe": op7_bpe,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": OP2_SQL,
        "op5_ngram_jaccard": OP5_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op9_embedding_dedup": OP9_SQL,
    }
