"""Statements over streams.

A streaming DataFrame registered with Engine.register() may stand wherever a table may. What
Structured Streaming supports then works: projections, filters, joins to static tables,
grouping in complete or update mode.
"""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery


def start(engine, text: str, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Runs a query over streams into the in-memory table name."""
    writer = engine.sql(text).writeStream.format("memory").queryName(name).outputMode(mode)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
