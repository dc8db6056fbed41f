"""Session settings and the two policies shared by every operator.

* ``build_session`` is for local runs and tests; on a cluster the session comes
  from the submitter and only its settings are read.
* ``checkpoint_dir`` honours ``spark.checkpoint.dir``.  Only a session that runs in one process gets a folder of its own when
  it names none; on a cluster that is an error, since executors do not share local folders.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def build_session(cores: int | None = None, app: str = "fleetsift") -> SparkSession:
    """A local session: AQE on, UTC, one shuffle partition per core."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "8g"))
        .config("spark.fleetsift.spread", str(n))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, set from its own configuration."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="fleetsift-ckpt-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration's result in the reliable checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column that later steps read instead of computing it again.

    Spark merges neighbouring projections and pushes filters through them, which copies an
    expensive expression to every place it is used.  A one-element generator ends that: the value
    is computed once per row.  The outer form keeps a filter from being inferred from it.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
