"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a table up to this size may be sent to every executor
BROADCAST_BYTES = 32 << 20


def build_session(master: str | None = None, name: str = "tabulith", **conf: str) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings win where they exist."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one uses its warehouse folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def _scratch_root(spark: SparkSession):
    """The application's folder for written tables, as a path and its file system."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/written-{spark.sparkContext.applicationId}")
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table, inside the shared folder. It is gone after the application, or after
    ``discard_scratch``."""
    root, files = _scratch_root(spark)
    if not files.exists(root):
        files.mkdirs(root)
        files.deleteOnExit(root)
    return f"{root.toString()}/{label}-{uuid.uuid4().hex}"


def discard_scratch(spark: SparkSession) -> None:
    """Delete the tables written so far, once their results have been read."""
    root, files = _scratch_root(spark)
    files.delete(root, True)


def written_once(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for wide tables that several passes read a
    few columns of."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard_table(table: DataFrame) -> None:
    """Delete a table of ``written_once`` that nothing reads any more."""
    for file in table.inputFiles()[:1]:
        jvm = table.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory: 8 a column and 16 a row, and what texts hold."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    return sum(wide, F.lit(16 + 8 * len(df.columns)))


def table_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def lookup(df: DataFrame) -> DataFrame:
    """A reduced table to join a big one with: computed first, and broadcast if it turns out small.

    Left to the adaptive planner alone, the big side is shuffled while the small side's size is
    still unknown.
    """
    fixed = cut_lineage(df)
    return F.broadcast(fixed) if table_bytes(fixed) <= BROADCAST_BYTES else fixed


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, safe against lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
