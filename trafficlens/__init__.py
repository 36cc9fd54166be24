"""trafficlens: API-traffic analytics expressed as Spark DataFrame / SQL plans.

Layout:
  sources/    readers for landed pages, NDJSON, Arrow IPC streams; table views; sinks
  operators/  filter compiler, metrics aggregation, request-log query, store writes,
              request-details assembly
  functions/  column functions (JSON, headers, time ranges)
  plans/      ready-made investigation queries and the query catalog
  streaming/  incremental landing with Structured Streaming
"""

from trafficlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
