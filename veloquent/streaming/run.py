"""Run a streaming query over everything that is there and hand back its result as a batch table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Temporary folders of local masters that name none, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local master without the setting gets a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        shared = _LOCAL[app] = _LOCAL.get(app) or tempfile.mkdtemp(prefix="veloquent-")
    return shared.rstrip("/")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet file or folder as a stream with the schema that it has."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name.replace('.parquet', '.parquet*')}")


#: State stores by name; a query takes the session's when it starts.
STORES = {"rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drain(stream: DataFrame, mode: str = "append", state_store: str | None = None) -> DataFrame:
    """Process all available input once and return what was written; ``state_store`` names another store than the session's."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(_PROVIDER)
    if state_store:
        spark.conf.set(_PROVIDER, STORES[state_store])
    try:
        running = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process all available input once in update mode and return each key's last update.

    A batch writes its updates to a folder of its own, which a repeated batch replaces.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/{number:08d}")

    running = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, __batch int").option("recursiveFileLookup", "true").parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__x")).select(*keys, *(F.col(f"__x.{c}").alias(c) for c in rest))
