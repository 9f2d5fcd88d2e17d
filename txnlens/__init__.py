"""txnlens: card-transaction features, text rendering, sampling and vector
evaluation expressed as Spark DataFrame jobs.

Layout:
  sources/    table readers, stand-in views, CSV / JSONL ingest, sinks
  functions/  Column-level helpers (scalar features, vectors, text, rendering)
  operators/  DataFrame -> DataFrame operators (features, split, metrics, ...)
  plans/      plan checks and size-checked broadcast helpers
  streaming/  Structured Streaming forms of the stateful operators
"""

from txnlens.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
