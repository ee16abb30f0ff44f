"""Session construction, table loading and lineage cuts shared by every module."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "clausemill", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine expects (UTC, Arrow, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CLAUSEMILL_DRIVER_MEMORY", "12g"))
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take work: one that comes as a single file is spread over the cores.

    Tables of many files are read as they lie; filters and column choices still reach
    the scan through the exchange.
    """
    frame = table(spark, sf_dir, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    single = path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).getFileStatus(path).isFile()
    return frame.repartition(spark.sparkContext.defaultParallelism) if single else frame


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent on one machine (tests) is a temporary folder made; a
    cluster without it is refused.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return configured or current.get()
    if not configured and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = configured or tempfile.mkdtemp(prefix="clausemill-")
    context.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder and continue from the files (lineage cut)."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, unless PYTHONPATH has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_clausemill_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="clausemill-"), "clausemill.zip")
    package = os.path.join(root, "clausemill")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._clausemill_shipped = True
