"""The corpus operators' registered queries, each over its whole table with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import ship

#: Module of each query's operator; the module's `query(spark, sf_dir)` applies it.
MODULES = {
    "op1_simhash": "simhash",
    "op2_embeddings": "pivots",
    "op3_lines": "lines",
    "op4_passages": "chains",
    "op5_fingerprints": "sketch",
    "op6_mixture": "mixture",
    "op7_packing": "packing",
    "op8_secrets": "secrets",
    "op9_language": "langid",
    "op10_shards": "sharding",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return importlib.import_module(f"{__package__}.{MODULES[name]}").query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express on whole tables."""
    from . import mixture

    return {"op6_mixture": mixture.ORACLE}
