"""Tables in the folder that all executors share: lineage ends there, and lost executors cost the tasks they ran."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a written table (compressed) up to which it may be broadcast; beyond, Spark shuffles.
BROADCAST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="quirelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    at = new_dir(spark, what)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def size_of(spark: SparkSession, at: str) -> int:
    """Bytes of a folder's files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def small(df: DataFrame, what: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Like written, for one side of a join: with a hint to broadcast it if what was written is no larger than `most` bytes."""
    spark = df.sparkSession
    at = new_dir(spark, what)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    return F.broadcast(out) if size_of(spark, at) <= most else out


def exists(spark: SparkSession, at: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
