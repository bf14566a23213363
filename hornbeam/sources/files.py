"""Parquet and other tables as predicates, and relations as tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.values import as_text


def register_tables(engine: Engine, path: str, names: Iterable[str], format: str = "parquet") -> Engine:
    """Bind ``{path}/{name}.{format}`` to the predicate ``name`` for each name; columns in file order are the arguments."""
    for name in names:
        engine.register(name, engine.spark.read.format(format).load(f"{path}/{name}.{format}"))
    return engine


def write_relation(engine: Engine, name: str, path: str, columns: Iterable[str] | None = None, format: str = "parquet") -> None:
    """Write a relation as a table, its columns under the given names. Mixed columns become text."""
    df = engine.relation(name).df
    for f in df.schema:
        if f.dataType.simpleString().startswith("struct"):
            df = df.withColumn(f.name, as_text(F.col(f.name)))
    (df.toDF(*columns) if columns else df).write.format(format).mode("errorifexists").save(path)
