"""Session construction for local work and tests; on a cluster the session is the caller's."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where a session has none (as in tests), one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        found = found or "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(found)
    return (found or held.get()).rstrip("/")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lattica", **conf: str) -> SparkSession:
    """A local session with UTC time, AQE and Arrow on; `conf` overrides any of it."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """The parquet table `name` under `sf_dir` (any path that Spark's readers open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
