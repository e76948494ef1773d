"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, str] = {}  # of local sessions that name no folder, by application


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode without it, a new temporary folder."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _made[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "zstd", drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of files, not the recomputation of what made
    them. The schema is kept, so an empty frame comes back empty with its columns. With ``drop_shuffles``
    Spark deletes the shuffle files that made the table once it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(DROPS, "false")
    if drop_shuffles:
        spark.conf.set(DROPS, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(DROPS, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame of ``materialise`` that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
