"""lithic: a Spark-first engine for table profiling, record linkage and corpus preparation."""

__version__ = "0.1.0"
