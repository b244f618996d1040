"""Session set-up and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "paritylens", **conf: str) -> SparkSession:
    """A session for one machine; a cluster's own session is used as it is."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(os.cpu_count() or 8) if cores == "*" else str(cores),
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map={**base, **conf})
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    ``spark.checkpoint.dir`` of the session names it.  Where that setting is
    absent, a session on one machine gets a temporary folder, which goes when
    the interpreter ends; on a cluster it must be set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="paritylens-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    The table outlives a lost executor, so nothing before this point is
    computed again, and it is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paritylens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Remove the tables that ``cut_lineage`` wrote for this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/paritylens/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A small table in one file would leave all work per row to one task.  The
    pieces a scan will have follow from the planner's estimate of its size and
    the number of its files; nothing is run to find out.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    conf = spark._jsparkSession.sessionState().conf()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # As a scan is cut: every file counts as if it had some bytes more.
    padded = size + len(df.inputFiles()) * conf.filesOpenCostInBytes()
    piece = min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), padded / cores))
    return df if padded / piece > cores - 1 else df.repartition(cores)
