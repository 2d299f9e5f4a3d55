"""Session helpers: a local session for tests, and tables in the shared folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("logloom")
    defaults = {"spark.sql.shuffle.partitions": str(cores), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``, which all executors share. A local folder is set where none is and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="logloom-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Written once and read back, so that later steps see the same rows and lost executors cost no recomputation."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
