"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Runtime settings; safe to apply to a session somebody else made.
RUNTIME = {
    # naive times are read as UTC and served as UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # mails come in any character set, and with broken bytes
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: int | str = "*", name: str = "tidewell") -> SparkSession:
    """A local session for tests and benchmarks."""
    shuffles = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", shuffles)
        .config("spark.ui.showConsoleProgress", "false")
        # plans are built once per micro-batch; a call site per expression is a good part of that
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
