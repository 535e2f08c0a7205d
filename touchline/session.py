"""Session settings the plans are tuned for."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Wide expressions fused into one stage give generated methods over 8000 bytes,
    # which the JVM would only interpret; this lets it compile them.
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    # A hot player, fixture or team is split at the join even when that costs
    # one more shuffle afterwards.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(master: str | None = None, app: str = "touchline", **extra: str) -> SparkSession:
    """Session for the jobs. ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """Folder for written state that all executors see: under the shared folder the
    cluster names in ``spark.checkpoint.dir``, and where that is unset, as in tests on
    one machine, under the session's warehouse. On a cluster an unset folder is refused:
    the warehouse may be the driver's own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "touchline-state")
    return os.path.join(root, name)


def compile_wide_rows(spark: SparkSession) -> None:
    """Keep the JVM from interpreting the plans of wide records in a session that was not
    built here: stages whose fused method is above the 8000 bytes that the JVM compiles
    run unfused, in methods that it does compile. A session with the JVM option of
    ``SETTINGS``, or with a limit of its own, is left as it is."""
    option = "-XX:-DontCompileHugeMethods"
    if all(option in spark.conf.get(f"spark.{where}.extraJavaOptions", "") for where in ("driver", "executor")):
        return
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > 8000:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def released_shuffles(spark: SparkSession):
    """Within it, the shuffle files of an action are removed when the action ends. Else they
    stay until the driver happens to collect its garbage, and a job of many steps holds
    those of all its steps. For actions whose result is written or a few rows."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def large_listings(spark: SparkSession):
    """Within it, the folders of a table are listed by a few tasks per core instead of a task
    per folder."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    return _setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks))
