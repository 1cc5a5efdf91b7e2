"""Session set-up and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine; on a cluster spark-submit builds the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("provenix")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "4g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    A folder of this machine is chosen only where none is set and the master is ``local``, where every task
    runs in this process; on any other master a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="provenix-")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made; survives the loss of executors.

    A checkpoint still carries the constraints of its plan, which in a loop of joins grow with every round until planning
    takes longer than running; so the rows are handed on as a plan of their own.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def shared_table(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written table."""
    return f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
