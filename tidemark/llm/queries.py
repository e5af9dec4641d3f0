"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import op5_byte_bpe
from tidemark.llm.extraction import op4_template_slots
from tidemark.llm.linededup import op8_line_runs
from tidemark.llm.neardup import op9_lsh_forest
from tidemark.llm.packing import op3_best_two_fit
from tidemark.llm.pii import op1_disclosure
from tidemark.llm.quality import op2_latent_neighbours
from tidemark.llm.rules import op6_ngram_ratio
from tidemark.llm.search import op10_block_max_wand
from tidemark.llm.toxicity import op7_string_kernel

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_disclosure": op1_disclosure,
    "op2_latent_neighbours": op2_latent_neighbours,
    "op3_best_two_fit": op3_best_two_fit,
    "op4_template_slots": op4_template_slots,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_ngram_ratio": op6_ngram_ratio,
    "op7_string_kernel": op7_string_kernel,
    "op8_line_runs": op8_line_runs,
    "op9_lsh_forest": op9_lsh_forest,
    "op10_block_max_wand": op10_block_max_wand,
}

ORACLE: dict[str, str] = {}
