"""The dialect over streams: a SELECT on a registered streaming DataFrame is a streaming DataFrame.

    engine.register("events", spark.readStream.schema(s).parquet(path).withWatermark("ts", "10 minutes"))
    start(engine, "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type", "counts", checkpoint)
"""

from __future__ import annotations

from pyspark.sql.streaming.query import StreamingQuery

from ..errors import PlanError
from ..session import Engine


def start(engine: Engine, sql: str, name: str, checkpoint: str, *, mode: str = "complete", once: bool = True, format: str = "memory", path: str | None = None) -> StreamingQuery:
    """Starts a SELECT over streams into a sink. With once it takes what is there and stops; checkpoint makes it go on there."""
    df = engine.sql(sql)
    if not df.isStreaming:
        raise PlanError("none of the tables is a stream")
    writer = df.writeStream.queryName(name).outputMode(mode).format(format).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path) if path else writer.start()
