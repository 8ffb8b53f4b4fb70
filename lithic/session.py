"""Session construction shared by tests, the benchmark and examples."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "lithic", cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution on and the settings the engine relies on."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
