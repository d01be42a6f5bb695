"""The queries of this subpackage by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .crf import op8_quality
from .ctw import op1_ctw
from .embeddings import OP2_SQL, op2_embeddings
from .exact_dedup import OP13_SQL, op13_exact_dedup
from .line_dedup import op3_line_dedup
from .mixing import OP7_SQL, op7_mixing
from .periodic import op12_periodic
from .quality_rules import op10_quality_rules
from .simhash import op6_simhash
from .substrings import op9_substrings
from .trie import OP11_SQL, op11_prefix_trie
from .warc import OP5_SQL, op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw": op1_ctw,
    "op2_embeddings": op2_embeddings,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_substrings": op9_substrings,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic": op12_periodic,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLES: dict[str, str] = {"op2_embeddings": OP2_SQL, "op5_warc": OP5_SQL, "op7_mixing": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op13_exact_dedup": OP13_SQL}
