"""A stream of facts into an engine: every micro-batch is one update."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators.maintenance import Delta
from ..plans.terms import Atom, Const


def feed(engine: Engine, stream: DataFrame, predicate: str, op: str | None = None, on_change: Callable[[Delta], None] | None = None, checkpoint: str | None = None, limit: int = 100_000) -> StreamingQuery:
    """Assert the stream's rows as facts of ``predicate``; with ``op``, rows whose op is ``-`` are retracted.

    A micro-batch of more than ``limit`` rows is refused, as a change of that size is better registered as a
    table. Batches run one after the other in the caller's session, each to its end.
    """
    columns = [c for c in stream.columns if c != op]

    def batch(df: DataFrame, _: int) -> None:
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"a micro-batch of more than {limit} rows: register the table instead")
        sides: tuple[list[Atom], list[Atom]] = ([], [])
        for row in rows:
            sides[op is not None and row[op] == "-"].append(Atom(predicate, tuple(Const(row[c]) for c in columns)))
        delta = engine.update(add=sides[0], remove=sides[1])
        if on_change is not None:
            on_change(delta)

    writer = stream.writeStream.foreachBatch(batch).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
