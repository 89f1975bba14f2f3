"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embed_lsh, filter_audit, fm, hpylm, licenses, line_dedup, mixing, packing, quality_rules, runs, simhash, toxic, wacz


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_simhash": simhash.op2_simhash,
        "op3_embedding_lsh": embed_lsh.op3_embedding_lsh,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_wacz": wacz.op5_wacz,
        "op6_pitman_yor": hpylm.op6_pitman_yor,
        "op7_mixing": mixing.op7_mixing,
        "op8_quality_fm": fm.op8_quality_fm,
        "op9_packing": packing.op9_packing,
        "op10_toxic_segments": toxic.op10_toxic_segments,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_line_dedup": line_dedup.op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_lsh": embed_lsh.ORACLE_SQL,
        "op4_quality_rules": quality_rules.ORACLE_SQL,
        "op5_wacz": wacz.ORACLE_SQL,
        "op7_mixing": mixing.ORACLE_SQL,
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op13_line_dedup": line_dedup.ORACLE_SQL,
    }
