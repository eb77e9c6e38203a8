"""What __spark_entry__.py adds to its queries while this subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op8_source_mix": q.OP8_SQL, "op8_training_order": q.OP8_ORDER_SQL, "op11_centroids": q.OP11_SQL, "op13_lexical_search": q.OP13_SQL}
