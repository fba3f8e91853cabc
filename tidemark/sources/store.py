"""Tables that jobs write for their own later reads, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs in one process, a temporary one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if current.isEmpty():
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def fresh_table(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed now, its lineage cut by a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
