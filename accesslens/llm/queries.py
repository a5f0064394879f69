"""The ``opN_<name>`` queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_query
from .ctw import op2_query
from .embeddings import op10_query
from .html_text import op8_query
from .mixing import OP5_SQL, op5_query
from .neardup import OP9_SQL, op9_query
from .pii import op1_query
from .quality import OP7_SQL, op7_query
from .secret_scan import op4_query
from .warc import OP3_SQL, op3_query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_query,
        "op2_ctw": op2_query,
        "op3_warc": op3_query,
        "op4_secrets": op4_query,
        "op5_mixing": op5_query,
        "op6_bpe": op6_query,
        "op7_quality": op7_query,
        "op8_html": op8_query,
        "op9_neardup": op9_query,
        "op10_embeddings": op10_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": OP3_SQL,
        "op5_mixing": OP5_SQL,
        "op7_quality": OP7_SQL,
        "op9_neardup": OP9_SQL,
    }
