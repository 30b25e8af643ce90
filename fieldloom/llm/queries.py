"""The registered queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import chat, curve_packing, divergence, embeddings, filter_audit, html_text, imatch, language_id, mixing, packing, quality, simhash, warc
from fieldloom.sources.package import ship


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, once the executors have this package."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_chat": chat.op1_chat,
        "op2_embeddings": embeddings.op2_embeddings,
        "op3_warc": warc.op3_warc,
        "op4_language_id": language_id.op4_language_id,
        "op5_html": html_text.op5_html,
        "op6_mixing": mixing.op6_mixing,
        "op7_imatch": imatch.op7_imatch,
        "op8_quality": quality.op8_quality,
        "op9_simhash": simhash.op9_simhash,
        "op10_packing": packing.op10_packing,
        "op11_divergence": divergence.op11_divergence,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_curve_packing": curve_packing.op13_curve_packing,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat.OP1_SQL, "op2_embeddings": embeddings.OP2_SQL, "op3_warc": warc.OP3_SQL, "op6_mixing": mixing.OP6_SQL, "op11_divergence": divergence.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL}
