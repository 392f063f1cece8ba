"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomplan.llm import class_lm, decontaminate, edit_counts, jaccard_join, license_scan, line_dedup, order_minhash, packing, quality_gam, spelling, super_minhash, token_output, word_runs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_class_lm": class_lm.op1_class_lm,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_edit_counts": edit_counts.op3_edit_counts,
        "op4_contained_items": decontaminate.op4_contained_items,
        "op5_quality_gam": quality_gam.op5_quality_gam,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_token_output": token_output.op9_token_output,
        "op10_order_minhash": order_minhash.op10_order_minhash,
        "op11_super_minhash": super_minhash.op11_super_minhash,
        "op12_word_runs": word_runs.op12_word_runs,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_contained_items": decontaminate.OP4_SQL,
        "op7_jaccard_join": jaccard_join.OP7_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op11_super_minhash": super_minhash.OP11_SQL,
        "op12_word_runs": word_runs.OP12_SQL,
        "op13_spelling_variants": spelling.OP13_SQL,
    }
