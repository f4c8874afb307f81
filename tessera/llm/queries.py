"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import alignment, bpe, chat_tools, exact_dedup, hnsw, html_extract, lattice_lm, mixing, near_dedup, substring_dedup, token_output, toxicity, yinyang
from tessera.llm.common import table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_tools": lambda s, d: chat_tools.op1(table(s, d, "conversations")),
        "op2_toxicity": lambda s, d: toxicity.op2(table(s, d, "documents"), table(s, d, "labels")),
        "op3_exact_dedup": lambda s, d: exact_dedup.op3(table(s, d, "documents")),
        "op4_lattice_lm": lambda s, d: lattice_lm.op4(table(s, d, "documents"), piece_bpe()),
        "op5_hnsw": lambda s, d: hnsw.op5(table(s, d, "embeddings")),
        "op6_html_extract": lambda s, d: html_extract.op6(table(s, d, "pages")),
        "op7_substring_dedup": lambda s, d: substring_dedup.op7(table(s, d, "documents")),
        "op8_mixing": lambda s, d: mixing.op8(table(s, d, "documents")),
        "op9_near_dedup": lambda s, d: near_dedup.op9(table(s, d, "documents")),
        "op10_bpe": lambda s, d: bpe.op10(table(s, d, "documents"), word_bpe()),
        "op11_token_output": lambda s, d: token_output.op11(table(s, d, "documents"), byte_bpe()),
        "op12_yinyang": lambda s, d: yinyang.op12(table(s, d, "embeddings")),
        "op13_alignment": lambda s, d: alignment.op13(table(s, d, "documents"), byte_bpe(), piece_bpe()),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_tools": chat_tools.SQL, "op3_exact_dedup": exact_dedup.SQL, "op8_mixing": mixing.SQL, "op12_yinyang": yinyang.SQL}
