"""Queries of the dialect over unbounded tables.

A registered DataFrame may be a stream: filters, projections and joins with bounded tables run on it as they
stand, and grouped queries keep their groups' state. This module starts such a query.
"""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from millrace.session import Engine


def start(engine: Engine, text: str, name: str, checkpoint: str, sink: str = "memory", **options: str) -> StreamingQuery:
    """Run a query over streaming tables, with all input there is at each trigger. Grouped queries give their whole result each time."""
    result = engine.sql(text)
    if not result.isStreaming:
        raise ValueError("None of the query's tables is a stream")
    mode = "complete" if engine.analyze(text)[0].aggregated else "append"
    return result.writeStream.format(sink).outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).options(**options).start()
