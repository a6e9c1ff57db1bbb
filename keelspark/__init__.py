"""Agent-workload analytics on PySpark: profiling, record layouts, routing, indexes, time series, vectors, state and cost."""

__version__ = "0.1.0"
