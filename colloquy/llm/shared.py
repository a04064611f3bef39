"""What the operators share: the cluster's shared folder and words by fixed white space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Contract's white space; ``bytes.split()`` cuts at exactly these six.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset, as in local tests, a folder of the machine is set instead.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The one folder under which an application writes all it keeps between steps."""
    return f"{shared_dir(spark)}/colloquy-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_run(spark: SparkSession) -> None:
    """Removes what this application wrote; call it when no result is read any more, as results are made from these files."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(run_dir(spark))
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: the lineage ends and lost executors lose nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text"):
    """The text with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Rows that Spark hands to a Python worker at once; documents are long, so few are enough.
BATCH_ROWS = "500"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; from here on Python workers get small batches, as whole texts take much memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
