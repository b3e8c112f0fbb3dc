"""Tables that cut lineage: written to the shared folder named by ``spark.checkpoint.dir`` and reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local masters that name none, by application.
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The session's shared folder. Only a local master without the setting gets a temporary one."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        shared = _LOCAL[app] = _LOCAL.get(app) or tempfile.mkdtemp(prefix="veloquent-")
    return shared.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later reads start from those files, so a lost executor never repeats the work before them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that ``materialize`` returned, once nothing reads it any more; other tables stay."""
    path = getattr(df, "_scratch", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
