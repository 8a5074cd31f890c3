"""The shared folder of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only where the setting is absent and everything runs in one process (tests)
    is a temporary folder used instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rosterlake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Takes away a folder that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: How Parquet is written. Rows may be whole batches of half a MB: pages and groups are looked at after few rows, so that no task holds many of them, and the codec needs no buffer of a whole page.
PARQUET = {"compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size.row.check.min": "10"}
#: The same for long texts and nested rows. Spark's reader unpacks a whole row group at once (4,096 rows at most), and texts that are alike pack thirtyfold, so groups are kept small, in bytes as they are stored and in rows.
LONG = PARQUET | {"parquet.block.size": str(1 << 20), "parquet.block.row.count.limit": "1024"}


def written(df: DataFrame, what: str, options: dict[str, str] = PARQUET) -> DataFrame:
    """df, written to the shared folder and read again. options: LONG if its rows may be long."""
    path = shared_path(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)
