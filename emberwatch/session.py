"""Session defaults."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Label, score and rule expressions are wide. Above this size HotSpot refuses to
    # compile the generated method, so Spark should split the expressions instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Deriving filters from the aliases of a wide projection grows exponentially with
    # their number; the operators state the filters they need.
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# The part of the defaults that can be set on a session somebody else started.
RUNTIME_CONF = ["spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit",
                "spark.sql.mapKeyDedupPolicy",
                "spark.sql.constraintPropagation.enabled"]


# What one task of a registered query reads or fetches at most, so that its memory does not grow with the tables.
QUERY_CONF = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
}


def apply_query_conf(spark: SparkSession) -> SparkSession:
    """Defaults of the operators and, for tables of any size, small tasks."""
    for key, value in QUERY_CONF.items():
        spark.conf.set(key, value)
    return apply_runtime_conf(spark)


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    for key in RUNTIME_CONF:
        spark.conf.set(key, SESSION_CONF[key])
    return spark


def get_session(app: str = "emberwatch", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults the operators expect; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="emberwatch-ckpt-", dir=os.environ.get("TMPDIR")))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for tables that feed the next round of a loop: the plan goes on with the size that the table has.

    A checkpoint keeps the estimated size, estimates of joins multiply, and after some
    rounds the planner would work on numbers of millions of digits.
    """
    kept = df.persist()
    kept.count()
    out = cut_lineage(kept.select("*"))
    kept.unpersist()
    return out
