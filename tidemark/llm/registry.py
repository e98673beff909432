"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import bpe, decontamination, language, lines, minhash, neighbours, quality, scoring, sharding, toxicity


def queries() -> dict:
    return {
        "op1_minhash": minhash.query,
        "op2_bpe": bpe.query,
        "op3_lines": lines.query,
        "op4_decontamination": decontamination.query,
        "op5_toxicity": toxicity.query,
        "op6_quality": quality.query,
        "op7_neighbours": neighbours.query,
        "op8_scoring": scoring.query,
        "op9_language": language.query,
        "op10_sharding": sharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontamination.SQL}
