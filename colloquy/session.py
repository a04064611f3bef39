"""Session settings the library expects; a cluster's own settings win."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "colloquy", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that submit gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _shared(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/colloquy-{spark.sparkContext.applicationId}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that driver and executors share (spark.checkpoint.dir) and read again.

    Cuts the lineage of repeated steps, so that a plan does not hold all steps before it and lost
    executors lose nothing. Only where the setting is unset, as in local tests, a folder of the
    machine is taken. All lies in one folder for each application, which :func:`remove_settled` removes.
    """
    spark = df.sparkSession
    path = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a task reads of a table or of a shuffle.
TASK_BYTES = 16 << 20


def bounded(spark: SparkSession) -> None:
    """Has tasks read ``TASK_BYTES`` where Spark's defaults are larger, so their memory doesn't grow with the tables; other values stay."""
    for key, default in (("spark.sql.files.maxPartitionBytes", "128MB"), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")):
        if spark.conf.get(key) in (default, {"128MB": "134217728b", "64MB": "67108864b"}[default]):
            spark.conf.set(key, str(TASK_BYTES))


def compiled(spark: SparkSession) -> None:
    """Has generated methods over 8,000 bytes made in smaller ones, as the JVM never compiles longer ones; a limit that was set stays."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def remove_settled(spark: SparkSession) -> None:
    """Removes what this application wrote; call it when no result is read any more, as results are made from these files."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(_shared(spark))
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)
