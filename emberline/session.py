"""Session settings the engine relies on, for local runs and for tests."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
HUGE_CONF, HUGE_DEFAULT = "spark.sql.codegen.hugeMethodLimit", "65535"


def local_session(cpus: int | str = 8, app: str = "emberline", memory: str = "16g") -> SparkSession:
    """Local session used by the bench and the tests; on a cluster pass your own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def compiled(spark: SparkSession) -> None:
    """Have Spark run a stage without whole-stage code where a generated method exceeds what the JVM compiles.

    Beyond 8000 bytes of bytecode a method is interpreted for ever; Spark's own limit is 65535. A limit that the session has set stays.
    """
    if spark.conf.get(HUGE_CONF, HUGE_DEFAULT) == HUGE_DEFAULT:
        spark.conf.set(HUGE_CONF, "8000")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` wins; a folder is chosen here only on a local master where
    neither the setting nor an earlier ``setCheckpointDir`` exists (local runs and tests).
    On a cluster a machine-local folder would lose data, so a missing setting is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get(CHECKPOINT_CONF)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join("/tmp", f"spark-checkpoint-{sc.applicationId}"))
    return df.checkpoint(eager=True)
