"""Session construction with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: Bytes of one Arrow batch between the JVM and a Python worker; each task holds a few of them on both sides.
BATCH_BYTES = 4 * 2**20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of Arrow batches to ``BATCH_BYTES``, since texts are of any length and the built-in bound counts rows first. A lower one stays."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_KEY)) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def build_session(app: str = "loamline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow; ``conf`` overrides (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        _BATCH_KEY: str(BATCH_BYTES),
        "spark.ui.enabled": os.environ.get("LOAMLINE_UI", "false"),
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
